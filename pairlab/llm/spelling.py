"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Two words one edit apart keep their first half or the rest of it: with s the length of the
shorter one and k = s // 2, both have the same first k code points or the same last s - k.
Each word goes to the bucket of its prefix and of its suffix, for s its own length and one
less. Buckets are dealt to groups of about ``GROUP_ROWS`` rows; a larger bucket is cut into
blocks, and every pair of blocks is a group, so no task grows with a bucket.

A group holds, for every position and letter, the set of its words with that letter there,
one bit for a word. All words as queries then read their letters one by one; three
sets for each query, held as words of 64 bits, follow at once: no error so far, one letter
replaced, and one letter more in the indexed word (read one position further on). A
task emits for each of its words the number of near words and the most frequent one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.session import truncate_lineage

RUN = "[A-Za-zÀ-ÿ]{%d,}"  # maximal runs of at least so many letters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP_ROWS = 2048
BROADCAST_BUCKETS = 200_000  # hot buckets, about 60 bytes each
PARTIAL = "word string, n_near bigint, best_n bigint, best string"


def vocabulary(docs: DataFrame, text: str, alter: Column | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of all runs of letters in all texts, A-Z lower-cased; null texts have none.

    ``alter`` is an expression over the columns of ``docs`` and ``run`` (the lower-cased run,
    at least ``least_length`` long) that replaces it before words are counted. Words are
    counted before the shuffle.
    """
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN % least_length), F.lit(0)))
    keep = [c for c in docs.columns if c not in (text, "run")]
    found = docs.select(*[F.col(f"`{c}`") for c in keep], runs.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    words = found.select((F.col("run") if alter is None else alter).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _bits(member: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words; the width is a multiple of 64."""
    return np.packbits(member, axis=1, bitorder="little").view(np.uint64)


class PositionIndex:
    """The bit sets of a list of words: by letter at a position, and by length."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.array([len(w) for w in words], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters, codes = np.unique(points, return_inverse=True)
        self.codes = codes.ravel()
        self.width = -(-max(len(words), 1) // 64) * 64
        self.lengths = np.unique(self.size)
        by_length = np.zeros((len(self.lengths) + 1, self.width), bool)
        by_length[np.searchsorted(self.lengths, self.size), np.arange(len(words))] = True
        self.by_length = _bits(by_length)  # the last row is empty

    def at(self, position: int) -> np.ndarray:
        """For each letter the words that have it at ``position``."""
        member = np.zeros((len(self.letters) or 1, self.width), bool)
        rows = np.flatnonzero(self.size > position)
        member[self.codes[self.offset[rows] + position], rows] = True
        return _bits(member)

    def of_length(self, length: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.lengths, length)
        k = np.where((k < len(self.lengths)) & (self.lengths[np.minimum(k, len(self.lengths) - 1)] == length), k, len(self.lengths))
        return self.by_length[k]

    def near(self, queries: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, word) with one letter replaced, then pairs (query, word) with one letter more in the word.

        Both arguments are numbers of words of the list.
        """
        queries = queries[np.argsort(-self.size[queries], kind="stable")]
        size = self.size[queries]
        start = np.zeros((1, self.width), bool)
        start[0, indexed] = True
        exact = np.repeat(_bits(start), len(queries), axis=0)
        replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
        here = self.at(0)
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -i, "left"))  # queries longer than i come first
            then = self.at(i + 1)
            letter = self.codes[self.offset[queries[:live]] + i]
            same = here[letter]
            z, r, m = exact[:live], replaced[:live], longer[:live]
            longer[:live] = (m | z) & then[letter]
            replaced[:live] = (r & same) | (z & ~same)
            exact[:live] = z & same
            here = then
        replaced &= self.of_length(size)
        longer = (longer | exact) & self.of_length(size + 1)
        return *self._pairs(queries, replaced), *self._pairs(queries, longer)

    @staticmethod
    def _pairs(queries: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, w = np.nonzero(found)
        bits = np.unpackbits(np.ascontiguousarray(found[q, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(bits)
        return queries[q[k]], 64 * w[k] + b


def _group(part: pd.DataFrame) -> pd.DataFrame:
    """Near words inside the buckets of one group, reduced to one row for each word."""
    words, n = part["word"].tolist(), part["n"].to_numpy(np.int64)
    s, kind = part["s"].to_numpy(np.int64), part["kind"].to_numpy()
    bucket = part["bucket"].to_numpy(np.int64)
    head = np.unique([w[: k // 2] for w, k in zip(words, s, strict=True)], return_inverse=True)[1].ravel()
    index = PositionIndex(words)
    queries = np.flatnonzero(part["asks"].to_numpy(bool) & (index.size == s))
    q0, w0, q1, w1 = index.near(queries, np.flatnonzero(part["listed"].to_numpy(bool)))
    q, w, more = np.concatenate([q0, q1]), np.concatenate([w0, w1]), np.repeat([False, True], [len(q0), len(q1)])
    tail = np.array([x[len(x) - (k - k // 2) :] for x, k in zip(words, s, strict=True)])
    # the same bucket, and in a suffix bucket only what the prefix bucket does not show
    ok = (bucket[q] == bucket[w]) & (s[q] == s[w]) & (kind[q] == kind[w])
    ok &= np.where(kind[q] == 0, head[q] == head[w], (head[q] != head[w]) & (tail[q] == tail[w]))
    q, w, more = q[ok], w[ok], more[ok]
    owner, other = np.concatenate([q, w[more]]), np.concatenate([w, q[more]])
    names, rank = np.unique(np.array(words, object), return_inverse=True)  # objects compare by code point
    rank = rank.ravel()
    order = np.lexsort((rank[other], -n[other], rank[owner]))
    owner, other = owner[order], other[order]
    new = np.flatnonzero(np.concatenate([[True], rank[owner][1:] != rank[owner][:-1]])) if len(owner) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(owner)))
    return pd.DataFrame({"word": names[rank[owner[new]]], "n_near": count, "best_n": n[other[new]], "best": names[rank[other[new]]]})


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a word one edit apart.

    ``words`` has unique non-empty ``word`` and ``n``; ``best`` is the near word of largest n, of
    equals the smallest in code-point order.
    """
    spark = words.sparkSession
    m = F.length("word")

    def row(s: Column, kind: int) -> Column:
        half = F.floor(s / 2).cast("int")
        key = F.substring("word", F.lit(1), half) if kind == 0 else F.right("word", s - half)
        return F.struct(s.alias("s"), F.lit(kind).alias("kind"), F.xxhash64(key).alias("bucket"))

    rows = F.array(*[row(s, kind) for s in (m, m - 1) for kind in (0, 1)])
    dealt = words.select("word", "n", F.explode(rows).alias("r")).select("word", "n", "r.*").filter("s > 0")
    sizes = dealt.groupBy("s", "kind", "bucket").agg(F.count("*").alias("rows"))
    sizes = truncate_lineage(sizes.groupBy((F.col("rows") > group_rows).alias("hot"), F.when(F.col("rows") > group_rows, F.struct("s", "kind", "bucket", "rows")).alias("of")).agg(F.sum("rows").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = 1 + total // group_rows
    hot = sizes.filter("hot").select("of.*")
    if hot.count() <= BROADCAST_BUCKETS:  # else both sides are shuffled
        hot = F.broadcast(hot)
    placed = dealt.join(hot, ["s", "kind", "bucket"], "left")
    columns = ["word", "n", "s", "kind", "bucket"]
    place = F.pmod(F.xxhash64("s", "kind", "bucket"), F.lit(groups))
    cold = placed.filter("rows is null").select(*columns, F.lit(True).alias("asks"), F.lit(True).alias("listed"), place.alias("g"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    blocks = F.ceil(F.col("rows") / group_rows).cast("int")
    large = placed.filter("rows is not null").withColumn("mine", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    named = (-1 - F.abs(F.xxhash64("s", "kind", "bucket") % F.lit(1 << 40))).alias("g")
    asks = large.select(*columns, F.lit(True).alias("asks"), (F.col("mine") == F.col("other")).alias("listed"), named, F.col("mine").alias("p"), F.col("other").alias("q"))
    listed = large.filter("mine <> other").select(*columns, F.lit(False).alias("asks"), F.lit(True).alias("listed"), named, F.col("other").alias("p"), F.col("mine").alias("q"))
    found = cold.unionByName(asks).unionByName(listed).groupBy("g", "p", "q").applyInPandas(_group, PARTIAL)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): from each word along the forms to the last, by pointer doubling."""
    up = truncate_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = truncate_lineage(up.join(over, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        up = step.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n).

    A word's form is its near word of largest n (of equals the smallest in code-point
    order), if that n is at least ``ratio`` (2 or more) times the word's own; the root is the
    last form reached from it, or the word itself. Null or empty words and null counts are
    left out; the counts of a repeated word are added up. An empty table gives no rows.
    """
    words = words.filter("length(word) > 0 and n is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = truncate_lineage(words)
    near = words.join(near_words(words, group_rows), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    )
    formed = truncate_lineage(formed)
    root = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
