"""Token counts: prefix dynamic programming over words, exact at every prefix of a text."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import require_columns

#: Words of at most so many characters whose counts a worker remembers; the oldest half goes beyond that number.
CACHE_WORDS, CACHE_CHARS = 400_000, 256
#: Words of at most so many bytes look up only the prefixes that are asked for; longer ones go from left to right.
ASKED_BYTES = 256
END = "</w>"
UNMERGED = 1 << 60
SOLID = regex.compile(r"\S+")


@lru_cache(maxsize=1)
def differing_letters() -> dict[str, tuple[str, str]]:
    """For the classes L, N and s: what the tokenizers library's tables have beyond those of `regex`, and what they lack, as ranges for a set."""
    # there are none in the planes beyond
    every = "".join(chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000)

    def ranges(chars: set[str]) -> str:
        out: list[list[int]] = []
        for c in sorted(map(ord, chars)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)

    found = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        theirs = {c for piece, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every) for c in piece}
        own = set(regex.findall(pattern, every))
        found[name] = ranges(theirs - own), ranges(own - theirs)
    return found


def library_pattern(pattern: str) -> tuple[regex.Pattern, regex.Pattern | None]:
    """`pattern`, whose sets are of L, N and white space, with the library's classes; and one that finds characters for which it matters."""
    odd = differing_letters()
    if not any(x for pair in odd.values() for x in pair):
        return regex.compile(pattern), None

    def own(name: str, plain: str) -> str:
        more, less = odd[name]
        base = f"[{plain}--[{less}]]" if less else f"[{plain}]"
        return f"[{base}||[{more}]]" if more else base

    sets = {r"\p{L}": own("L", r"\p{L}"), r"\p{N}": own("N", r"\p{N}"), r"\s": own("s", r"\s")}
    for plain, careful in sets.items():
        pattern = pattern.replace(plain, careful)
    return regex.compile(pattern, regex.V1), regex.compile("[" + "".join(x for pair in odd.values() for x in pair) + "]")


class PrefixCounter:
    """Exact counts of a word-final BPE vocabulary (a tokenizers .json with NFC, white-space and lower-case normalizers).

    For each prefix of a word the program stores the last token of its encoding and the number of tokens. A
    token may follow another one only if encoding their joint text gives just these two, and the encoding of
    a prefix is the encoding of what precedes its last token plus that token; so each prefix needs a look at
    the tokens that end there, and no text is encoded again to answer for a shorter one.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-casing BPE vocabulary with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words_re = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.careful_re, self.odd_re = library_pattern(self.words_re.pattern)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars: dict[str, str] = {}
        self._level = level
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.totals: dict[str, int] = {}

    def _bytes_of(self, char: str) -> str:
        if char not in self.byte_chars:
            self.byte_chars[char] = "".join(p for p, _ in self._level.pre_tokenize_str(char))
        return self.byte_chars[char]

    def _merge(self, symbols: list[str]) -> list[str]:
        rank_of = self.ranks.get
        while len(symbols) > 1:
            ranks = [rank_of(p, UNMERGED) for p in zip(symbols, symbols[1:], strict=False)]
            lowest = min(ranks)
            if lowest == UNMERGED:
                break
            at = ranks.index(lowest)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and token != END else list(token)

    def _follows(self, last: str, token: str) -> bool:
        if len(self.pairs) > 4 * CACHE_WORDS:
            self.pairs.clear()
        fits = self.pairs[last, token] = self._merge(list(last) + self._symbols(token)) == [last, token]
        return fits

    def _step(self, text: str, end: int, inner: list[tuple[str, int] | None], suffix: str) -> tuple[str, int]:
        vocab, pairs = self.vocab, self.pairs
        for start in range(max(0, end - self.longest), end):
            token = text[start:end] + suffix
            if token not in vocab:
                continue
            if start == 0:
                if self._alone(token):
                    return token, 1
                continue
            before = inner[start]
            if before is None:
                before = inner[start] = self._step(text, start, inner, "")
            last, count = before
            known = pairs.get((last, token))
            if known or known is None and self._follows(last, token):
                return token, count + 1
        raise ValueError("a byte has no token")

    def _alone(self, token: str) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self._merge(self._symbols(token)) == [token]
        return known

    def _inner(self, text: str) -> list[tuple[str, int]]:
        inner: list[tuple[str, int]] = [("", 0)]
        for end in range(1, len(text)):
            inner.append(self._step(text, end, inner, ""))
        return inner

    def word_total(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.totals.get(word)
        if known is None:
            # visible ASCII characters stand for their own bytes
            text = word if word.isascii() and word.isprintable() else "".join(map(self._bytes_of, word))
            inner = [None] * len(text) if len(text) <= ASKED_BYTES else self._inner(text)
            known = self.totals[word] = self._step(text, len(text), inner, END)[1]
        return known

    def words_total(self, words: list[str]) -> int:
        """Tokens of pre-tokens, each distinct one looked at once."""
        return sum(self.word_counts(words))

    def word_counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, each distinct one looked at once."""
        known = self.totals
        if len(known) > CACHE_WORDS:
            for old in list(known)[: len(known) - CACHE_WORDS // 2]:
                del known[old]
        long = {}
        for word in set(words).difference(known):
            if len(word) > CACHE_CHARS:
                long[word] = self.word_total(word)
                del known[word]
            else:
                self.word_total(word)
        return [long[w] if w in long else known[w] for w in words] if long else list(map(known.__getitem__, words))

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each non-empty prefix of one pre-token, by characters."""
        parts = [self._bytes_of(c) for c in word]
        text, out, end = "".join(parts), [], 0
        inner = self._inner(text)
        for part in parts:
            end += len(part)
            out.append(self._step(text, end, inner, END)[1])
        return out

    def _splitter(self, low: str) -> regex.Pattern:
        """The pattern of pre-tokens; with the library's own letters where `low` has one that other tables know otherwise."""
        return self.words_re if self.odd_re is None or low.isascii() or not self.odd_re.search(low) else self.careful_re

    def _split(self, low: str) -> list[str]:
        return self._splitter(low).findall(low)

    def pieces(self, text: str) -> Iterator[tuple[str, bool, int]]:
        """Plain stretches and special tokens of a text, with where they start."""
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            if m.start() > at:
                yield text[at : m.start()], False, at
            yield m[0], True, m.start()
            at = m.end()
        if at < len(text):
            yield text[at:], False, at

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character lower-cased by itself."""
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray, list]:
        """(ends, tokens, pieces) of a text, in one walk: where each of its units ends and the tokens up to there.

        A unit is a pre-token, a special token, or, where normalising changes lengths, a run without white
        space: such runs can't change each other. pieces has (first unit, start, text, match of each unit) per stretch.
        """
        ends, counts, pieces = [], [], []
        for piece, special, at in self.pieces(text):
            low = piece if special else self.normal(piece)
            if special:
                pieces.append((len(ends), at, piece, None))
                ends.append(at + len(piece))
                counts.append(1)
            elif len(low) == len(piece) and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
                found = list(self._splitter(low).finditer(low))
                pieces.append((len(ends), at, low, found))
                ends += [at + m.end() for m in found]
                counts += self.word_counts([m[0] for m in found])
            else:
                found = list(SOLID.finditer(piece))
                pieces.append((len(ends), at, None, found))
                ends += [at + m.end() for m in found]
                counts += [self.words_total(self._split(self.normal(m[0]))) for m in found]
        return np.array(ends, dtype=np.int64), np.cumsum(np.array(counts, dtype=np.int64)), pieces

    def count_and_cut(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and the length of its longest prefix of at most `limit` tokens, from the counts at its prefixes."""
        if len(text) * 4 <= limit:
            # a byte has one token at most
            return sum(1 if special else self.words_total(self._split(self.normal(piece))) for piece, special, _ in self.pieces(text)), len(text)
        ends, upto, pieces = self.units(text)
        total = int(upto[-1]) if upto.size else 0
        if total <= limit:
            return total, len(text)
        unit = int(np.searchsorted(upto, limit, side="right"))
        base = int(upto[unit - 1]) if unit else 0
        first, at, low, found = next(p for p in reversed(pieces) if p[0] <= unit)
        # white space before the unit has no tokens
        m = found[unit - first] if found else None
        best = at + m.start() if m else at
        if m is None or base == limit:
            return total, best
        if low is not None:
            prefixes = self._within(low, m)
        else:
            # a token is never longer than the longest, so prefixes beyond that many characters are over the limit
            longest = min(len(m[0]), (limit - base) * self.longest + 1)
            prefixes = [self.words_total(self._split(self.normal(m[0][:i]))) for i in range(1, longest + 1)]
        return total, best + max((i for i, n in enumerate(prefixes, 1) if base + n <= limit), default=0)

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to its length."""
        out, base = np.zeros(len(text) + 1, dtype=np.int64), 0
        plain, plain_at = "", 0
        for piece, special, at in self.pieces(text):
            if special:
                # a prefix that ends inside a special string is ordinary text
                mixed = self._plain(plain + piece)
                out[at : at + len(piece)] = base + mixed[len(plain) : len(plain) + len(piece)]
                base += int(self._plain(plain)[-1]) + 1
                out[at + len(piece)] = base
                plain, plain_at = "", at + len(piece)
            else:
                plain, plain_at = piece, at
                out[at : at + len(piece) + 1] = base + self._plain(piece)
        return out

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, dtype=np.int64)
        low = self.normal(text)
        if len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            count = end = 0
            for m in self._splitter(low).finditer(low):
                out[end + 1 : m.start() + 1] = count
                prefixes = self._within(low, m)
                out[m.start() + 1 : m.end() + 1] = [count + p for p in prefixes]
                count, end = count + prefixes[-1], m.end()
            out[end + 1 :] = count
            return out
        # composed or expanded characters: white space parts what can change together
        count = end = 0
        for m in SOLID.finditer(text):
            out[end + 1 : m.start() + 1] = count
            for i in range(m.start() + 1, m.end() + 1):
                out[i] = count + sum(map(self.word_total, self._split(self.normal(text[m.start() : i]))))
            count, end = int(out[m.end()]), m.end()
        out[end + 1 :] = count
        return out

    def _within(self, low: str, m: regex.Match) -> list[int]:
        word = m[0]
        if len(word) > 1 and word[0] == "'" and word[1:] in ("s", "t", "re", "ve", "m", "ll", "d"):
            # a shorter prefix is a quote and letters, or another contraction
            return [sum(map(self.word_total, self._split(word[:i]))) for i in range(1, len(word) + 1)]
        return self.word_prefixes(word)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Add n_bytes, n_tokens, over_limit and cut_chars to every row; columns of these names are replaced.

    `vocabulary` is the tokenizer file's path on every worker. cut_chars is the length of the longest prefix
    of at most `limit` tokens: one walk stores the count at every word's end, and inside the word that
    crosses the limit at every character. Null texts count as empty: 0
    bytes, 0 tokens. Whole texts are counted, repeated rows one by one.
    """
    require_columns(docs, text)

    @F.pandas_udf("struct<n_tokens:long,cut_chars:long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dp = counter(vocabulary)
        for texts in batches:
            both = [dp.count_and_cut(t, limit) if t else (0, 0) for t in texts]
            yield pd.DataFrame(both, columns=["n_tokens", "cut_chars"], dtype="int64")

    new = ("n_bytes", "n_tokens", "over_limit", "cut_chars")
    kept = [F.col(c) for c in docs.columns if c not in new]
    return docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count(F.col(text)).alias("__c")).select(
        *[c for c in docs.columns if c not in new], "n_bytes", "__c.n_tokens", (F.col("__c.n_tokens") > limit).alias("over_limit"), "__c.cut_chars"
    )


def prefix_tables(docs: DataFrame, vocabulary: str, text: str = "text", column: str = "prefix_tokens") -> DataFrame:
    """Add the token count of every prefix, by code points, as an array of length + 1 ints; null text gives [0].

    ``element_at(prefix_tokens, n + 1)`` is the count of the first n characters, so any truncation or budget
    question is a look-up.
    """
    require_columns(docs, text)

    @F.pandas_udf("array<int>")
    def tables(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dp = counter(vocabulary)
        for texts in batches:
            yield pd.Series([dp.table(t or "").astype(np.int32) for t in texts])

    return docs.withColumn(column, tables(F.col(text)))
