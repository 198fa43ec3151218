"""Token counts by prefix dynamic programming.

A byte-level BPE encodes the pieces of its split pattern one by one.  For one piece, the last token of the encoding of
every prefix follows from those of shorter prefixes: it is the one token t that ends there and that stays next to the
last token before it (the two re-encode to themselves).  count[i] = count[i - len(t)] + 1.  The table of a piece answers
for all its prefixes; pieces recur, so tables are kept in a bounded cache of each task.  A text's count is the sum
over its pieces, and the counts at piece ends are running sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces and token pairs that a task keeps; when full, the cache starts anew.
CACHE = 1_000_000
#: Fixed value: the split pattern of this kind of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 is itself, the other
    bytes follow from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class PrefixCounter:
    """Exact counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are counted by prefix tables")
        letters = _byte_letters()
        self.tokens = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.by_id = {i: t for t, i in self.tokens.items()}
        tails: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                tails.setdefault(t[-3:], {1, 2}).add(len(t))
        #: Lengths that tokens with these last three bytes have, longest first.
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        #: Rank of the merge of two tokens; each token's right edge and left edge: (token there, rank of the merge that takes it).
        self.ranks: dict[int, int] = {}
        right, left = ({i: [(i, 1 << 30)] for i in self.by_id} for _ in range(2))
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (self.tokens[bytes(letters[c] for c in x)] for x in (m if isinstance(m, list) else m.split(" ")))
            made = self.tokens[self.by_id[a] + self.by_id[b]]
            self.ranks[a << 32 | b] = rank
            right[made] += [(x, min(r, rank)) for x, r in right[b]]
            left[made] += [(x, min(r, rank)) for x, r in left[a]]
        self.right, self.left = right, left
        self.split = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}

    def stays(self, pair: int) -> bool:
        """Whether two adjacent tokens are left as they are: no merge across the border comes before the merges that take
        the tokens it would join.  Of merges of one rank the left one comes first."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        edge = self.left[pair & 0xFFFFFFFF]
        for x, taken in self.right[pair >> 32]:
            for y, taken_too in edge:
                r = self.ranks.get(x << 32 | y)
                if r is not None and r < taken and r <= taken_too:
                    self.pairs[pair] = False
                    return False
        self.pairs[pair] = True
        return True

    def table(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i]."""
        n, token, pair_ok, tails = len(data), self.tokens.get, self.pairs.get, self.tails.get
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for k in tails(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - k
                if start < 0 or (t := token(data[start:end])) is None:
                    continue
                if start:
                    pair = last[start] << 32 | t
                    ok = pair_ok(pair)
                    if not (self.stays(pair) if ok is None else ok):
                        continue
                counts[end], last[end] = counts[start] + 1, t
                break
        return counts

    def piece(self, piece: str) -> int:
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            data = piece.encode()
            out = self.pieces[piece] = 1 if data in self.tokens else self.table(data)[-1]
        return out

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        known = self.pieces.get
        return sum([known(p) or self.piece(p) for p in self.split.findall(text)])

    def prefixes(self, text: str) -> list[int]:
        """out[i]: tokens of text[:i], for every code point i.

        A piece's prefix is cut off as the library would cut it off where the text ended there: white space before a
        cut is one piece, and a contraction that is not complete is split.  Such prefixes are counted on the
        stretch since the last safe boundary alone, a few characters long.
        """
        out, done = [0], 0
        marks = list(self.special.finditer(text)) if self.special else []
        at = 0
        for m in [*marks, None]:
            end = m.start() if m else len(text)
            for unit in self._units(text[at:end]):
                data = unit.encode()
                if not unit[0].isspace() and "'" not in unit and self.split.fullmatch(unit):
                    counts, i = self.table(data), 0
                    for ch in unit:
                        i += len(ch.encode())
                        out.append(done + counts[i])
                else:
                    out.extend(done + self.count(unit[:i]) for i in range(1, len(unit) + 1))
                done = out[-1]
            if m:
                mark = m.group()
                out.extend(done + self.count(mark[:i]) for i in range(1, len(mark)))
                done += 1
                out.append(done)
                at = m.end()
        return out

    def _units(self, text: str) -> Iterator[str]:
        """Stretches that are encoded apart whatever follows: white space goes with the piece after it, and pieces
        without white space between them from an apostrophe on stay together with it."""
        unit = ""
        for p in self.split.findall(text):
            if unit and not unit[-1].isspace() and not p.startswith("'") and not unit.endswith("'"):
                yield unit
                unit = ""
            unit += p
        if unit:
            yield unit


@cache
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def n_tokens(text: Column, name: str = TOKENIZER) -> Column:
    """Exact count for every text; a null text counts as empty.

    Byte-level BPE .json files use prefix tables.  Other .json files and .model files are counted by their library.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        path = str(tokenizer_path(name))
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            one = lambda t: len(sp.encode(t, add_bos=False, add_eos=False))
        else:
            try:
                one = _counter(path).count
            except ValueError:
                from tokenizers import Tokenizer

                tk = Tokenizer.from_file(path)
                one = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
        for texts in batches:
            yield pa.array([one(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def prefix_counts(text: Column, name: str = TOKENIZER) -> Column:
    """array<int>: the token count of every code-point prefix, the empty one first.  Null texts count as empty."""

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        c = _counter(str(tokenizer_path(name)))
        return texts.map(lambda t: c.prefixes(t or ""))

    return counts(text)


def longest_within(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix whose count is within budget, from the stored counts alone."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit for every row, in whole texts of any length.

    Null texts count as empty; repeated rows are counted one by one; an empty table gives an empty result; other columns
    are left out.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, name).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
