"""Token columns built from Spark expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids of the code point tokenizer, just above the last code point.
CODEPOINTS = 0x110000
BOS_ID = CODEPOINTS
EOS_ID = CODEPOINTS + 1
PAD_ID = CODEPOINTS + 2

# The mark that stands for a blank inside vocabulary pieces (U+2581).
WORD_MARK = "▁"

INT_LIST = "array<int>"
# Code points that are decoded by a lookup.
LISTED_POINTS = 0x800


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_ids() -> Column:
    return F.array().cast(INT_LIST)


def codepoint_ids(text: str | Column = "text") -> Column:
    """One id per character: its code point."""
    t = _col(text)
    ids = F.transform(F.split(t, ""), lambda c: F.ascii(c))
    return F.when(t.isNull() | (t == ""), empty_ids()).otherwise(ids)


def codepoint3_ids(text: str | Column = "text") -> Column:
    """Code points of the first three characters."""
    return codepoint_ids(F.substring(_col(text), 1, 3))


def byte_ids(text: str | Column = "text") -> Column:
    """One id per UTF-8 byte."""
    pairs = F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-8")), F.lit("(..)"), F.lit(1))
    ids = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))
    return F.coalesce(ids, empty_ids())


def whitespace_pieces(text: str | Column = "text") -> Column:
    """The words of a text, as strings for a vocabulary lookup."""
    words = F.regexp_extract_all(_col(text), F.lit(r"(?U)([^\s\x1C-\x1F]+)"), F.lit(1))
    return F.coalesce(words, F.array().cast("array<string>"))


TOKENIZERS = {"codepoint": codepoint_ids, "codepoint3": codepoint3_ids, "byte": byte_ids}


def truncate(ids: str | Column, max_length: int) -> Column:
    return F.slice(_col(ids), 1, max_length)


def append_eos(ids: str | Column, eos_id: int | None) -> Column:
    """Close a non-empty list with EOS unless it ends with one; no EOS id, no change."""
    c = _col(ids)
    if eos_id is None:
        return c
    open_end = (F.size(c) > 0) & (F.try_element_at(c, F.lit(-1)) != eos_id)
    return F.when(open_end, F.concat(c, F.array(F.lit(eos_id)))).otherwise(c)


def attention_mask(ids: str | Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(_col(ids)))


def tokenize(
    text: str | Column = "text",
    tokenizer: str = "codepoint",
    max_length: int | None = None,
    eos_id: int | None = None,
) -> Column:
    """Token ids of a text: truncated first, closed with EOS second."""
    ids = TOKENIZERS[tokenizer](text)
    if max_length is not None:
        ids = truncate(ids, max_length)
    return append_eos(ids, eos_id)


def token_count(
    text: str | Column = "text",
    tokenizer: str = "codepoint",
    max_length: int | None = None,
    eos_id: int | None = None,
) -> Column:
    """The size of ``tokenize``'s list; code points are counted without making the list."""
    if tokenizer != "codepoint" or (eos_id is not None and eos_id < CODEPOINTS):
        return F.size(tokenize(text, tokenizer, max_length, eos_id))
    n = F.coalesce(F.char_length(_col(text)), F.lit(0))
    if max_length is not None:
        n = F.least(n, F.lit(max_length))
    return n if eos_id is None else n + (n > 0).cast("int")


def _one(value: int | None) -> list[Column]:
    return [] if value is None else [F.array(F.lit(value))]


def add_special(
    a: str | Column,
    b: str | Column | None = None,
    bos_id: int | None = BOS_ID,
    eos_id: int | None = None,
) -> Column:
    """``[bos] a [eos]``, and ``[bos] b [eos]`` after it for a pair."""
    parts = [*_one(bos_id), _col(a), *_one(eos_id)]
    if b is not None:
        parts += [*_one(bos_id), _col(b), *_one(eos_id)]
    return F.concat(*parts)


def special_tokens_mask(
    a: str | Column, b: str | Column | None = None, bos: bool = True, eos: bool = False
) -> Column:
    """1 where ``add_special`` puts a special id, 0 on content."""
    edge_bos, edge_eos = _one(1 if bos else None), _one(1 if eos else None)
    parts: list[Column] = []
    for seq in [a] if b is None else [a, b]:
        parts += [*edge_bos, F.array_repeat(F.lit(0), F.size(_col(seq))), *edge_eos]
    return F.concat(*parts)


def existing_special_mask(ids: str | Column, special_ids: Sequence[int]) -> Column:
    """The mask of a list that already holds its special ids."""
    return F.transform(_col(ids), lambda x: x.isin(*special_ids).cast("int"))


def token_type_ids(
    a: str | Column, b: str | Column | None = None, bos: bool = True, eos: bool = False
) -> Column:
    """0 over the first sequence with its special ids, 1 over the second."""
    edges = int(bos) + int(eos)
    first = F.array_repeat(F.lit(0), F.size(_col(a)) + edges)
    if b is None:
        return first
    return F.concat(first, F.array_repeat(F.lit(1), F.size(_col(b)) + edges))


def pad_or_eos(pad_id: str | Column, eos_id: str | Column) -> Column:
    """A vocabulary without a pad token pads with EOS."""
    return F.coalesce(_col(pad_id), _col(eos_id))


def _char(c: Column) -> Column:
    """The character of a code point: frequent ones from a constant list."""
    listed = F.split(F.lit("".join(map(chr, range(LISTED_POINTS)))), "")
    wide = F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32")
    return F.when((c >= 0) & (c < LISTED_POINTS), F.get(listed, c)).otherwise(wide)


def _text(pieces: Column) -> Column:
    return F.replace(F.array_join(pieces, ""), F.lit(WORD_MARK), F.lit(" "))


def decode_codepoint(
    ids: str | Column,
    specials: Mapping[int, str] | None = None,
    skip_special: bool = False,
    spaces_between: bool = False,
) -> Column:
    """The text of a list of code points and special ids.

    Special ids give their content or, with ``skip_special``, nothing. With
    ``spaces_between`` a blank separates special tokens from each other and from the
    runs of text between them. The word mark becomes a blank.
    """
    c = _col(ids)
    specials = {i: "" if skip_special else content for i, content in dict(specials or {}).items()}
    special_ids = list(specials)

    def render(x: Column) -> Column:
        out = _char(x)
        for sid, content in specials.items():
            out = F.when(x == sid, F.lit(content)).otherwise(out)
        # Most ids are low code points and end here.
        low = [i for i in special_ids if i < LISTED_POINTS]
        return out if low else F.when((x >= 0) & (x < LISTED_POINTS), _char(x)).otherwise(out)

    def render_after(x: Column, before: Column) -> Column:
        parted = before.isNotNull() & (x.isin(*special_ids) | before.isin(*special_ids))
        return F.concat(F.when(parted, F.lit(" ")).otherwise(F.lit("")), render(x))

    if not spaces_between or skip_special or not specials:
        return _text(F.transform(c, render))
    # Each id meets the one before it in a second list: a look back into ``c`` from the
    # lambda could work the whole list out again for every id.
    n = F.size(c)
    earlier = F.slice(F.concat(F.array(F.lit(None).cast("int")), c), F.lit(1), n)
    return _text(F.zip_with(c, earlier, render_after))
