"""The contracts in plain Python."""

from collections import Counter


def interleave_all(sources):
    """One document of each source in turn; exhausted sources drop out."""
    out, rank = [], 0
    while any(rank < len(s) for s in sources):
        out += [s[rank] for s in sources if rank < len(s)]
        rank += 1
    return out


def interleave_first(sources):
    n = min(map(len, sources))
    return [s[rank] for rank in range(n) for s in sources]


def pack(lists, block_size, batch_size):
    """``{(batch, block): ids}`` of the full blocks of each batch."""
    batch_size = batch_size or max(1, len(lists))
    out = {}
    for start in range(0, len(lists), batch_size):
        line = [x for ids in lists[start : start + batch_size] for x in ids or []]
        for k in range(len(line) // block_size):
            out[start // batch_size, k] = line[k * block_size : (k + 1) * block_size]
    return out


def pretokenize(sources, block_size, batch_size, truncate=None, eos=None, cap=None, stop="all"):
    mixed = (interleave_all if stop == "all" else interleave_first)(sources)[:cap]
    lists = []
    for text in mixed:
        if text and text.strip():
            ids = [ord(c) for c in text][:truncate]
            lists.append(ids + [eos] if eos is not None and ids[-1] != eos else ids)
    return pack(lists, block_size, batch_size)


def merge_pair(symbols, pair, new):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def train(words, covered, merges_wanted):
    """One merge per step: ``[(left piece, right piece)]``; ties go to older symbols.

    A symbol's age is its code point for a character, and after those its first making.
    """
    age = {c: ord(c) for c in covered}
    state = [([c if c in age else None for c in w], n) for w, n in words.items()]
    learned, made = [], set()
    while len(made) < merges_wanted:
        counts = Counter()
        for symbols, n in state:
            for pair in zip(symbols, symbols[1:]):
                if None not in pair:
                    counts[pair] += n
        if not counts:
            break
        a, b = min(
            counts,
            key=lambda p: (-counts[p], max(age[p[0]], age[p[1]]), age[p[0]], age[p[1]]),
        )
        made.add(a + b)
        age.setdefault(a + b, 0x110000 + len(made) - 1)
        learned.append((a, b))
        state = [(merge_pair(s, (a, b), a + b), n) for s, n in state]
    return learned


def encode_word(symbols, ranks):
    """Apply the lowest-ranked merge, left-most first, until none is left."""
    symbols = list(symbols)
    while True:
        known = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not known:
            return symbols
        _, i = min(known)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def decode_pieces(ids, pieces, kinds, skip_special=False, spaces_between=False):
    """Runs of ordinary pieces become text on their own; special tokens stand between them."""
    parts, run = [], b""
    for i in ids:
        if kinds[i] not in ("control", "user"):
            run += bytes([int(pieces[i][3:5], 16)]) if kinds[i] == "byte" else pieces[i].encode()
        elif not skip_special:
            parts += [run.decode("utf-8", "replace")] * bool(run) + [pieces[i]]
            run = b""
    parts += [run.decode("utf-8", "replace")] * bool(run)
    return (" " if spaces_between else "").join(parts).replace("\u2581", " ")
