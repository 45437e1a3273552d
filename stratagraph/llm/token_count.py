"""Token counts by the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is worked out once,
before any text is read.  A text is cut into pre-tokens; those that are such
strings count one each, and only the rest goes through the tokenizer's
merges, once for each distinct pre-token.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces as in_pieces

#: Distinct merged pre-tokens that a Python worker remembers.
MEMO = 200_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def whole_tokens(tokenizer) -> frozenset[str]:
    """The vocabulary's strings that encode alone as exactly one token."""
    of = _bytes_of_chars()
    found = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            found.append(bytes(of[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # a part of a character: no text holds it alone
            continue
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return frozenset(s for s, e in zip(found, encoded) if len(e.ids) == 1)


class Counter:
    """Counts tokens as ``tokenizers`` does for one byte-level BPE file."""

    def __init__(self, path: str, whole: frozenset[str], odd: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = dict.fromkeys(whole, 1)
        self.memo: dict[str, int] = {}
        self.pieces = regex.compile(_PATTERN).findall
        self.odd = odd
        self.merge = self.tokenizer.model.tokenize
        self.chars = {b: c for c, b in _bytes_of_chars().items()}

    def count(self, text: str) -> int:
        if any(s in text for s in self.special) or not text.isascii() and not self.odd.isdisjoint(set(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces(text)
        if not pieces:
            return 0
        found = list(map(self.whole.get, pieces))
        rest = [p for p, n in zip(pieces, found) if n is None] if None in found else []
        if not rest:
            return len(found)
        new = {p for p in rest if p not in self.memo}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set(rest)
        for p in new:
            self.memo[p] = len(self.merge("".join(map(self.chars.__getitem__, p.encode()))))
        return len(found) - len(rest) + sum(map(self.memo.__getitem__, rest))


def odd_chars(path: str) -> frozenset[str]:
    """The characters that the pattern pre-tokenises otherwise than the library does.

    The two libraries' Unicode tables are not of one version.

    Each code point stands between a letter, a digit and a sign, where its
    class (letter, number, space or other) decides where the cuts fall.
    """
    import regex
    from tokenizers import Tokenizer

    pre, pieces = Tokenizer.from_file(path).pre_tokenizer, regex.compile(_PATTERN).findall
    odd = []
    for start in range(0x80, 0x110000, 4096):
        chars = [c for c in map(chr, range(start, min(start + 4096, 0x110000))) if not 0xD800 <= ord(c) <= 0xDFFF]
        if not chars or regex.search(r"\p{L}|\p{N}|\p{M}|\s|\p{P}|\p{S}|\p{Cf}", "".join(chars)) is None and start > 0x40000:
            continue
        text = "\n".join(f"a{c}1{c}!{c}" for c in chars)
        if [p[1] for p in pre.pre_tokenize_str(text)] != _spans(pieces(text)):
            for c in chars:
                one = f"a{c}1{c}!{c}"
                if [p[1] for p in pre.pre_tokenize_str(one)] != _spans(pieces(one)):
                    odd.append(c)
    return frozenset(odd)


def _spans(pieces: list[str]) -> list[tuple[int, int]]:
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


@functools.cache
def proof(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """What is worked out beforehand, once a driver: whole tokens, and code points to leave to the library."""
    from tokenizers import Tokenizer

    return whole_tokens(Tokenizer.from_file(path)), odd_chars(path)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    A null or empty text has 0 bytes and 0 tokens.  Special strings inside a
    text are taken as the tokenizer takes them by default.  Every row gets a
    row, repeated ids and null ids included.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__bytes"))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    proved = docs.sparkSession.sparkContext.broadcast(proof(path))  # bounded by the vocabulary

    def run(batches):
        of = _counters.get(path) or _counters.setdefault(path, Counter(path, *proved.value))
        for b in (piece for batch in batches for piece in in_pieces(batch, 1)):
            tokens = [of.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
