import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import bpe, vocab
from corpusloom.functions.tokens import WORD_MARK
from corpusloom.operators import sizing
from corpusloom.plans.pretokenize import PretokenizeOptions, pretokenize
from tests import models

BASE = len(vocab.RESERVED) + len(vocab.user_symbols()) + vocab.BYTES


def lines_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def random_lines(seed, n=40, letters="abc", longest=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
    return [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(n)]


def words_of(lines):
    import re

    return Counter(w for t in lines for w in re.findall(bpe.WORD_PATTERN, t.replace(" ", WORD_MARK)))


@pytest.mark.parametrize("seed,letters", [(0, "ab"), (1, "abcde"), (2, "aaab")])
def test_training_equals_one_merge_per_step(spark, seed, letters):
    lines = random_lines(seed, letters=letters)
    covered = set("".join(lines)) - {" "} | {WORD_MARK}
    wanted = 25
    pieces, merges = bpe.train_bpe(lines_of(spark, lines), BASE + len(covered) + wanted, coverage=1.0)
    learned = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    assert learned == models.train(words_of(lines), covered, wanted)
    ids = [r["id"] for r in pieces.collect()]
    assert sorted(ids) == list(range(BASE + len(covered) + wanted))


def test_round_acceptance_equals_single_steps():
    """The rule for merging several pairs at once, against one merge per step."""
    for seed in range(150):
        rng = random.Random(seed)
        letters = "abcdef"[: rng.randint(1, 6)]
        words = words_of(random_lines(seed, n=rng.randint(1, 25), letters=letters, longest=12))
        covered = set("".join(words))
        wanted = rng.randint(1, 40)
        piece = {ord(c): c for c in covered}
        known, learned = {}, []
        state = [([ord(c) for c in w], n) for w, n in words.items()]
        while wanted > len(known):
            counts = Counter()
            for symbols, n in state:
                for pair in zip(symbols, symbols[1:]):
                    counts[pair] += n
            ranked = sorted(counts, key=lambda p: (-counts[p], max(p), p))
            if not ranked:
                break
            for left, right in bpe.accept_prefix(ranked, piece, known, wanted - len(known)):
                text = piece[left] + piece[right]
                symbol = known.setdefault(text, bpe.CODEPOINTS + len(known))
                piece[symbol] = text
                learned.append((piece[left], piece[right]))
                state = [(models.merge_pair(s, (left, right), symbol), n) for s, n in state]
        assert learned == models.train(words, covered, wanted), seed


def test_training_stops_when_no_pair_is_left(spark):
    pieces, merges = bpe.train_bpe(lines_of(spark, ["ab ab"]), 10_000, coverage=1.0)
    assert {r["piece"] for r in pieces.where("kind = 'merge'").collect()} == {"ab", f"{WORD_MARK}ab"}
    with pytest.raises(ValueError, match="basic pieces"):
        bpe.train_bpe(lines_of(spark, ["ab"]), 10)


TEXTS = [
    "Seven herons, one pond!",
    "Nothing new here.",
    "A river (河川) runs past the Hügel.",
    "control bytes \x00 \x01\x7f end",
    "  two  blanks\n\tand lines ",
    "",
    "user <|user|> said<|eot_id|>",
    "😀 é",
]


@pytest.fixture(scope="module")
def model(spark):
    tables = bpe.train_bpe(lines_of(spark, ["hello world this is a test with mixed tests"] * 3), BASE + 60)
    return bpe.BpeModel.from_tables(*tables)


def test_round_trip(spark, model):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    encoded = bpe.encode_bpe(df, model)
    back = bpe.decode_bpe(encoded, model, out="back").orderBy("k").collect()
    assert [r["back"] for r in back] == TEXTS
    user = model.pieces.index("<|user|>")
    assert [r["k"] for r in back if user in r["input_ids"]] == [6]
    skipped = bpe.decode_bpe(encoded, model, out="back", skip_special=True).where("k = 6").head()
    assert skipped["back"] == "user  said"
    spaced = bpe.decode_bpe(encoded, model, out="back", spaces_between=True).where("k = 6").head()
    assert spaced["back"] == "user  <|user|>  said <|eot_id|>"


def test_decoding_equals_a_plain_decoder(spark, model):
    rng = random.Random(5)
    first = model.kinds.index("byte")
    near_bytes = [first + b for b in "é😀a".encode()] + [first + 0xFF, first + 0xC3]
    lists = [None, []] + [
        [rng.choice(near_bytes) if rng.random() < 0.6 else rng.randrange(len(model.pieces)) for _ in range(rng.randrange(40))]
        for _ in range(150)
    ]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, input_ids array<int>")
    for skip, spaces in ((False, False), (True, False), (False, True), (True, True)):
        got = bpe.decode_bpe(df, model, out="back", skip_special=skip, spaces_between=spaces)
        assert "Python" not in got._jdf.queryExecution().toString()
        want = [models.decode_pieces(x or [], model.pieces, model.kinds, skip, spaces) for x in lists]
        assert [r["back"] for r in got.orderBy("k").collect()] == want


def test_flow_with_a_vocabulary(spark, model):
    texts = [t for t in TEXTS if t.strip()] * 3
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "src_ord int, doc_ord bigint, text string")
    encode = bpe.text_encoder(model)
    for truncate in (None, 6):
        opts = PretokenizeOptions(7, 4, truncate=truncate, eos_id=vocab.EOS_ID, tokenizer=model)
        got = pretokenize(docs, opts).collect()
        lists = [encode(t)[:truncate] + [vocab.EOS_ID] for t in texts]
        assert {(r["batch_id"], r["block_ord"]): r["input_ids"] for r in got} == models.pack(lists, 7, 4)


def test_null_text_encodes_to_nothing(spark, model):
    df = spark.createDataFrame([(None,)], "text string")
    assert bpe.encode_bpe(df, model).head()["input_ids"] == []


def test_encoder_equals_the_plain_greedy_rule():
    for seed in range(200):
        rng = random.Random(seed)
        symbols = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        pieces, ranks = ["a", "b"], {}
        for _ in range(rng.randint(0, 8)):
            pair = rng.choice(pieces), rng.choice(pieces)
            if pair not in ranks:
                ranks[pair] = len(ranks)
                if pair[0] + pair[1] not in pieces:
                    pieces.append(pair[0] + pair[1])
        ids = {p: i for i, p in enumerate(pieces)}
        merges = {(ids[a], ids[b]): (r, ids[a + b]) for (a, b), r in ranks.items()}
        got = bpe.merge_word([ids[s] for s in symbols], merges)
        assert [pieces[i] for i in got] == models.encode_word(symbols, ranks), seed


def test_parity_counts_missing_and_differing_texts(spark):
    a = spark.createDataFrame([(1, [1]), (2, [2]), (3, None)], "k int, input_ids array<int>")
    b = spark.createDataFrame([(1, [1]), (2, [9]), (3, None)], "k int, input_ids array<int>")
    assert tuple(bpe.compare_tokenizations(a, b, ["k"]).head()) == (3, 2, 1)


def test_coverage_keeps_until_the_share_is_reached(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 8), ("c", 1), ("d", 1)], "ch string, n bigint")
    kept = lambda share: [r["ch"] for r in sizing.char_coverage(counts, share).orderBy("rank").collect()]
    assert kept(0.9) == ["a"]
    assert kept(0.98) == ["a", "b"]
    assert kept(0.985) == ["a", "b", "c"]
    assert kept(1.0) == ["a", "b", "c", "d"]


def test_uncovered_characters_take_part_in_no_merge(spark):
    lines = ["xaxa xa é"] * 5
    _, merges = bpe.train_bpe(lines_of(spark, lines), BASE + 8, coverage=0.85)
    assert all("é" not in r["left"] + r["right"] for r in merges.collect())


def test_long_lines_and_user_symbols(spark):
    lines = lines_of(spark, ["é" * 5, "abc", "a<|user|>b"])
    assert bpe.max_sentence_length(lines, 9).count() == 1
    words = {r["word"] for r in bpe.word_counts(lines).collect()}
    assert words == {"é" * 5, "abc", "a", "b"}


def test_vocabulary_tables(spark, tmp_path):
    specials = vocab.special_rows(spark)
    rows = {r["piece"]: r["id"] for r in specials.collect()}
    assert (rows["<pad>"], rows["<unk>"], rows["<|endoftext|>"]) == (0, 1, 2)
    assert len(rows) == len(vocab.DEFAULT_SPECIAL_TOKENS)
    asked = spark.createDataFrame([("<|user|>",), ("<none>",), ("<pad>",)], "piece string")
    table = vocab.special_token_table(asked, specials)
    assert {r["content"]: r["special"] for r in table.collect()} == {"<|user|>": True, "<pad>": True}
    looked = vocab.piece_to_id(asked, specials)
    assert {r["piece"]: r["id"] for r in looked.collect()}["<none>"] == 1
    none = spark.createDataFrame([], "rank int, left string, right string, id int")
    bpe.save_vocabulary(spark, specials, none, table, str(tmp_path / "v"))
    assert bpe.load_vocabulary(spark, str(tmp_path / "v"))[0].count() == len(rows)


def test_sizing(spark):
    def steps(n):
        col = None if n is None else F.col("n")
        df = spark.createDataFrame([(n or 0,)], "n bigint")
        return df.select(sizing.plan_steps(col, 4, 2, 2, 3)).head()[0]

    assert (steps(1000), steps(15), steps(None)) == (186, 0, 300_000)
    est = lambda rows: sizing.sample_count_estimate(
        spark.createDataFrame(list(enumerate(rows)), "f int, rows bigint"), "f"
    ).head()[0]
    assert (est([7]), est([10, 10, 4]), est([10, 10]), est([5, 9])) == (7, 24, 20, 10)
    req = spark.createDataFrame([(10, 3), (10, 10)], "v int, p int")
    assert [r[0] for r in req.select(sizing.required_vocab_size(F.col("v"), F.col("p"))).collect()] == [10, 11]


def test_long_lines_are_trained_on(spark):
    lines = spark.createDataFrame([("abab " * 5_000,), ("cd",)], "text string")
    _, merges = bpe.train_bpe(lines, 280, coverage=1.0)
    assert ("a", "b") in {(r["left"], r["right"]) for r in merges.collect()}
    _, merges = bpe.train_bpe(lines, 280, coverage=1.0, max_length=16_384)
    assert {(r["left"], r["right"]) for r in merges.collect()} == {("c", "d")}


def test_ids_leave_a_worker_in_small_arrays():
    texts = pa.array(["a" * 3, None, "", "b" * 9, "c", "d" * 6])
    assert list(bpe.text_groups(texts, 5)) == [["aaa", None, ""], ["b" * 9], ["c"], ["d" * 6]]
    kinds = ["control"] * 3 + ["char"] * 2
    one = bpe.array_encoder(bpe.BpeModel([*"012", "a", "b"], kinds, {}))
    ids = bpe.id_lists([one(t) for t in ("ab", None, "b")])
    assert ids.to_pylist() == [[3, 4], [], [4]] and ids.type == pa.list_(pa.int32())
    assert one("ab").itemsize * len(one("ab")) == 8  # four bytes an id, not a Python object


def test_a_full_memory_of_words_changes_no_id(monkeypatch):
    model = bpe.BpeModel([*"012", "a", "b", "▁", "ab"], ["control"] * 3 + ["char"] * 3 + ["merge"], {(3, 4): (0, 6)})
    text = "ab ba abab  b a" * 3
    whole = list(bpe.text_encoder(model)(text))
    monkeypatch.setattr(bpe, "PIECE_CACHE", 2)
    assert list(bpe.text_encoder(model)(text)) == whole
