"""Packing: length combinations that fill a window, repeat counts by non-negative least squares, greedy residuals.

Two documents' rests that fill a window exactly stay whole; only what finds no such partner is cut, into a
multiple of the grain and a tail, so that few lengths are left to combine.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from .common import checkpointed, require_columns

#: Fixed value: the public split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set of columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-7 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if trial[active].min(initial=1.0) > 0:
                x = trial
                break
            down = active & (trial <= 0)
            step = float(np.min(x[down] / np.maximum(x[down] - trial[down], 1e-300)))
            x = np.maximum(x + step * (trial - x), 0)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def combinations(lengths: list[int], window: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most `depth` lengths that sum to the window, and repeats of one length that fill most of it."""
    lengths = sorted(set(lengths), reverse=True)
    have, out = set(lengths), []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left in have and (not head or left <= head[-1]):
            out.append((*head, left))
        if len(head) + 1 < depth:
            for x in lengths:
                if (not head or x <= head[-1]) and x < left and x * (depth - len(head)) >= left:
                    grow((*head, x), left - x)

    grow((), window)
    return out + [(x,) * (window // x) for x in lengths if window // x > depth]


def plan_windows(histogram: dict[int, int], window: int, grain: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a window, how many such windows), covering the histogram exactly.

    Repeat counts of the shallow combinations solve the histogram by non-negative least squares and are
    rounded down, so none is used more often than its pieces last; what is left is packed greedily, largest
    first, a whole run of equal windows at a time. The work depends on the number of lengths, not of pieces.
    """
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    plan: list[tuple[tuple[int, ...], int]] = []
    coarse = sorted(x for x in left if x % grain == 0)
    # tails in pairs of one grain, so many that they fill a window, and by themselves
    tails = [(grain - x, x) * (window // grain) for x in left if x < grain - x and grain - x in left]
    combos = combinations(coarse, window, depth) + [tuple(sorted(t, reverse=True)) for t in tails] + [(x,) * (window // x) for x in left if x % grain]
    if combos:
        at = {x: i for i, x in enumerate(sorted(left))}
        a = np.zeros((len(at), len(combos)))
        for j, combo in enumerate(combos):
            for x in combo:
                a[at[x], j] += 1
        target = np.array([left[x] for x in sorted(left)], dtype=float)
        scale = 1.0 / np.maximum(np.sqrt(target), 1.0)
        for j in np.argsort(-(times := nonnegative_least_squares(a * scale[:, None], target * scale)), kind="stable"):
            n = min(int(times[j] + 1e-9), *(left[x] // k for x, k in Counter(combos[j]).items()))
            if n > 0:
                plan.append((combos[j], n))
                left.subtract({x: n * k for x, k in Counter(combos[j]).items()})
    left = +left
    while left:
        combo, room, rest = [], window, Counter(left)
        for x in sorted(left, reverse=True):
            k = min(rest[x], room // x)
            combo += [x] * k
            room -= k * x
        n = min(left[x] // k for x, k in Counter(combo).items())
        plan.append((tuple(combo), n))
        left.subtract({x: n * k for x, k in Counter(combo).items()})
        left = +left
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]], sequence: int = 0) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Which ranks of each length go where: (from_rank, to_rank, first_sequence, per_window, first_offset), by rank."""
    used: Counter = Counter()
    rows: dict[int, list] = {}
    for combo, n in plan:
        offset = 0
        for x, k in sorted(Counter(combo).items(), reverse=True):
            rows.setdefault(x, []).append((used[x], used[x] + n * k, sequence, k, offset))
            used[x] += n * k
            offset += x * k
        sequence += n
    return rows


PLACES = ["length", "part", "from_rank", "to_rank", "shift", "first_sequence", "per_window", "first_offset", "cut_start", "cut_length"]


def places(histogram: dict[int, int], window: int, grain: int) -> pd.DataFrame:
    """Where the pieces of each natural length go, by rank among them: whole (part 0), or cut to a head (1) and a tail (2).

    A piece at `rank` is number rank - shift of its slot. There are a few rows per length and combination.
    """
    rows, sequence = [], 0
    whole = {x: n for x, n in histogram.items() if x == window}
    for x, n in whole.items():
        rows.append((x, 0, 0, n, 0, sequence, 1, 0, 0, x))
        sequence += n
    for x in sorted(x for x in histogram if 2 * x <= window):
        y = window - x
        n = histogram[x] // 2 if x == y else min(histogram[x], histogram.get(y, 0))
        if not n:
            continue
        if x == y:
            rows.append((x, 0, 0, 2 * n, 0, sequence, 2, 0, 0, x))
        else:
            rows += [(x, 0, 0, n, 0, sequence, 1, 0, 0, x), (y, 0, 0, n, 0, sequence, 1, x, 0, y)]
        whole[x], whole[y] = (n, n) if x != y else (2 * n, 2 * n)
        sequence += n
    # the others are cut; pieces of one length are numbered through all natural lengths
    cut: dict[int, list[tuple[int, int, int, int, int]]] = {}
    left: Counter = Counter()
    for x in sorted(histogram):
        first, n = whole.get(x, 0), histogram[x] - whole.get(x, 0)
        head = x - x % grain
        parts = [(0, 0, x)] if head in (0, x) else [(1, 0, head), (2, head, x - head)]
        for part, start, length in parts if n else ():
            cut.setdefault(length, []).append((x, part, start, first, left[length]))
            left[length] += n
    plan = slots(plan_windows(left, window, grain), sequence)
    for length, holders in cut.items():
        for x, part, start, first, base in holders:
            last = base + histogram[x] - whole.get(x, 0)
            for low, high, first_sequence, per_window, offset in plan[length]:
                if low < last and high > base:
                    # global number = rank - first + base
                    rows.append((x, part, max(low, base) - base + first, min(high, last) - base + first, low - base + first, first_sequence, per_window, offset, start, length))
    return pd.DataFrame(rows, columns=PLACES, dtype="int64")


class ByteLevelTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE .json, from the same vocabulary as merge ranks.

    Files that say anything else than plain byte-level BPE are refused, and some texts are compared with the
    library's ids. Texts beyond `long_text` characters go to the library itself, as the faster matcher can run out of stack.
    """

    probes = ("Don't stop: it's 3.14,  \n\n\ttabs \u00e9\u65e5\u672c \U0001f642 x" * 2, "", "a", "  ", "<|endoftext|>a")

    long_text = 1_000_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or spec["truncation"] or not split or (split["type"], split["add_prefix_space"], split["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = {level.pre_tokenize_str(chr(c))[0][0]: c for c in range(128)}
        # the other bytes, in order, have the remaining characters of the byte alphabet, in order
        printable = [c for c in range(0xA1, 0x100) if c != 0xAD]
        chars |= {chr(c): c for c in printable}
        others = [c for c in range(128, 256) if c not in printable]
        chars |= dict(zip(sorted(set(level.alphabet()) - set(chars)), others, strict=True))
        ranks = {bytes(chars[x] for x in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        for text in self.probes:
            if self.ids(text).tolist() != self.library.encode(text, add_special_tokens=False).ids:
                raise ValueError("the vocabulary's ids differ from the library's")

    def ids(self, text: str) -> np.ndarray:
        if len(text) > self.long_text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


_TOKENIZERS: dict[str, ByteLevelTokenizer] = {}


def _tokenizer(path: str) -> ByteLevelTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteLevelTokenizer(path)
    return _TOKENIZERS[path]


CUT = ["start", "length", "ids_crc32", "head_crc32", "tail_crc32", "doc_tokens"]


def cut_documents(docs: DataFrame, vocabulary: str, doc_id: str, text: str, window: int, grain: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, head_crc32, tail_crc32): full windows and the rest of each document with its end id.

    The last two are for a rest cut at the last multiple of the grain.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(tokenizer.ids(text or ""), np.array([end_id], dtype="<u4"))
                for start in range(0, ids.size, window):
                    piece = ids[start : start + window]
                    head = piece.size - piece.size % grain
                    at.append(i)
                    found.append((start, piece.size, *(zlib.crc32(x.tobytes()) for x in (piece, piece[:head], piece[head:])), ids.size))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6
            # ids stay as they are, nulls and 64 bits too
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], names=["doc_id", *CUT])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(pieces, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in CUT)}")


def pack(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    grain: int = 32,
    end_id: int = 1,
    bucket_rows: int = 200_000,
) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; doc_id keeps its type and nulls.
    Null and empty texts are documents of the end id alone; repeated rows are packed one by one, and which of
    them goes where is as good as any; an empty table gives no rows. Only the histogram of natural lengths (at
    most `window`) reaches the driver. A piece's rank among its length is its bucket's first rank plus its place in
    the bucket, so that a length shared by most documents is ranked in many tasks.
    """
    require_columns(docs, doc_id, text)
    pieces = checkpointed(cut_documents(docs, vocabulary, doc_id, text, window, grain, end_id))
    buckets = max(8, -(-pieces.count() // bucket_rows))
    # numbered as they lie in the checkpoint, so that repeated rows spread over the buckets too
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.createDataFrame(places(lengths, window, grain), ", ".join(f"{c} long" for c in PLACES))
    # per length, buckets in order: sizes is a row per length and bucket, far fewer than pieces
    firsts = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("place", F.row_number().over(order) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("place"))
    # the places have a few rows per length and combination, whatever the number of documents
    joined = ranked.join(F.broadcast(where), "length").where("rank >= from_rank and rank < to_rank")
    within = F.col("rank") - F.col("shift")
    return joined.select(
        "doc_id",
        (F.col("start") + F.col("cut_start")).alias("start"),
        F.col("cut_length").alias("length"),
        F.when(F.col("part") == 1, F.col("head_crc32")).when(F.col("part") == 2, F.col("tail_crc32")).otherwise(F.col("ids_crc32")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - shift) div per_window")).alias("sequence_id"),
        (F.col("first_offset") + within % F.col("per_window") * F.col("cut_length")).alias("offset"),
    )
