"""Spelling variants: words one edit apart, each led to its much more frequent neighbour.

Two words are near if one code point inserted, deleted or replaced makes one the
other.  Of a pair whose longer word has c code points, the edit lies in the longer
word's first or second half; all before and all after that half is the same in
both.  So every word of c or c - 1 code points goes to two groups of class c, by
the part that must agree.  A group of over GROUP words is halved again, and so on
down to one position, where a group has no more words than the alphabet has letters:
no group is large, whatever a corpus holds.

Groups are dealt to tasks of about BIN words.  A task sorts its words forward and
in reverse (within groups).  Words that begin like a given word up to an edit
position are an interval of the first order, words that end like it after that
position an interval of the second; a wavelet tree over the reverse ranks in
forward order reports the words in both: those with another letter there, and, of
length c - 1, the one without it.  All positions of all words of a task are asked
together, level by level of the tree.  A deletion within a run of equal letters is
counted at the run's first letter, so each pair is found once, from one group.

Defined results: null texts have no words; a null doc_id is written as nothing when
runs are hashed; repeated rows count; runs of any length are taken whole; an empty
table has no words.  Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, trimmed

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Of so many hashed runs one loses a letter.
DROP = 31
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is so many times as frequent as the words led to it.
FACTOR = 10
#: Words of a group that may meet in one task, and words of a task.
GROUP, BIN = 4096, 50_000


def without_letter(run: Column, h: Column) -> Column:
    """The run without the code point at h % length."""
    at = (h % F.length(run)).cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def words(docs: DataFrame, drop: int = DROP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, some without a letter, that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all(docs["text"], F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))  # shorter ones only get shorter
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    word = F.when(h % drop == 0, without_letter(F.col("run"), h)).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def halves(rows: DataFrame) -> DataFrame:
    """rows (word, n, c, lo, hi: the edit is at lo … hi - 1 of the longer word) for either half of these positions, with
    key, a hash of what must agree."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    two = rows.select("word", "n", "c", F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))).alias("_r")).select("word", "n", "c", "_r.lo", "_r.hi").where("lo < hi")
    after = F.col("c") - F.col("hi")
    return two.withColumn("key", F.xxhash64("c", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - after + 1, after)))


def grouped(words: DataFrame, most: int = GROUP) -> DataFrame:
    """Every word with the groups (key, c, lo, hi) in which it may meet near words; groups of over `most` words are halved."""
    classes = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("c"))
    rows, done = halves(classes.withColumns({"lo": F.lit(0), "hi": F.col("c")})), []
    while True:
        crowded = table(rows.groupBy("key").agg(F.count("*").alias("held"), F.max(F.col("hi") - F.col("lo")).alias("wide")).where((F.col("held") > most) & (F.col("wide") > 1)).select("key"), "crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.union, [*done, rows])
        marked = table(rows.join(crowded.withColumn("_more", F.lit(True)), "key", "left").select(*rows.columns, F.col("_more").isNotNull().alias("_more")), "groups")
        done.append(marked.where("not _more").drop("_more"))
        rows = halves(marked.where("_more").drop("_more", "key"))


class WaveletTree:
    """Levels of a permutation's bits: which values stand in any interval of places, in any interval of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for b in reversed(range(self.bits)):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)])
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values in low … high - 1 at places left … right - 1, for all queries at once."""
        q, v = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, zeros, split in zip(reversed(range(self.bits)), self.zeros, self.split):
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = split + left - l0, split + right - r0
            q, left, right, v = np.r_[q, q], np.r_[l0, l1], np.r_[r0, r1], np.r_[v, v + (1 << b)]
            live = (left < right) & (v < high[q]) & (v + (1 << b) > low[q])
            q, left, right, v = q[live], left[live], right[live], v[live]
        return q, v


class Order:
    """Words sorted within their groups; intervals of words that agree in their first letters."""

    def __init__(self, group: np.ndarray, texts: list[str]):
        order = sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
        self.word = np.array(order, np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.word] = np.arange(len(order))
        size = np.array([len(texts[i]) for i in order], np.int64)
        first = np.cumsum(size) - size
        codes = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le"), np.uint32)
        # How many letters each word shares with the one before it; -1 at the first of a group.
        self.shared = np.where(np.r_[True, group[self.word][1:] != group[self.word][:-1]], -1, 0)
        at, d = np.flatnonzero(self.shared == 0), 0
        while len(at):
            at = at[(size[at] > d) & (size[at - 1] > d)]
            at = at[codes[first[at] + d] == codes[first[at - 1] + d]]
            d += 1
            self.shared[at] = d

    def intervals(self, word: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place, and the one after the last, of words that share the first letters, so many, of each given word."""
        left, right = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        rank, order = self.rank[word], np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        for d in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[d] : cuts[d + 1]]
            edges = np.r_[np.flatnonzero(self.shared < d), len(self.rank)]
            k = np.searchsorted(edges, rank[at], "right")
            left[at], right[at] = edges[k - 1], edges[k]
        return left, right


#: Queries that go down the tree together.
ASKED = 1 << 18


def near_in(group: np.ndarray, texts: list[str], c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Pairs (longer word or either of two alike in length, near word), by place in the lists."""
    size = np.array([len(t) for t in texts], np.int64)
    asks = np.flatnonzero(size == c)
    if not len(asks):
        return
    forward, reverse = Order(group, texts), Order(group, [t[::-1] for t in texts])
    tree = WaveletTree(reverse.rank[forward.word])
    total = np.cumsum(hi[asks] - lo[asks])
    begin = 0
    while begin < len(asks):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + ASKED, "right")))
        some = asks[begin:end]
        n = (hi - lo)[some]
        word = np.repeat(some, n)
        place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + lo[word]
        left, right = forward.intervals(word, place)
        low, high = reverse.intervals(word, c[word] - 1 - place)
        keep = (right - left > 1) & (high - low > 1)  # else the word itself alone
        word, place = word[keep], place[keep]
        q, v = tree.report(left[keep], right[keep], low[keep], high[keep])
        a, b, i = word[q], reverse.word[v], place[q]
        other = a != b
        a, b, i = a[other], b[other], i[other]
        # A letter fewer: only the first of equal letters stands for them.
        once = np.array([x == y or k == 0 or t[k] != t[k - 1] for x, y, k, t in zip(size[a].tolist(), size[b].tolist(), i.tolist(), map(texts.__getitem__, a.tolist()))], bool)
        yield a[once], b[once], size[a[once]] != size[b[once]]
        begin = end


def near_words(words: DataFrame, most: int = GROUP, bin_: int = BIN) -> DataFrame:
    """word, near, near_n: all near words of each of words (word, n)."""
    rows = grouped(words, most)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        texts, n = t.column("word").to_pylist(), t.column("n").combine_chunks()
        group = np.unique(t.column("key").to_numpy(), return_inverse=True)[1]
        c, lo, hi = (t.column(x).to_numpy().astype(np.int64) for x in ("c", "lo", "hi"))
        name = t.column("word").combine_chunks()
        for a, b, shorter in near_in(group, texts, c, lo, hi):
            x, y = pa.array(np.r_[a, b[shorter]]), pa.array(np.r_[b, a[shorter]])
            yield pa.record_batch([name.take(x), name.take(y), n.take(y)], ["word", "near", "near_n"])

    bins = rows.count() // bin_ + 1
    return rows.repartition(bins, "key").mapInArrow(trimmed(run), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) from each word that has one. Chains double in length each
    round; each form is FACTOR times as frequent as what leads to it, so they are short."""
    up = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = table(up.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        up = new.select("word", "root")
        if new.where("moved").isEmpty():
            return up


def variants(counted: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of counted (word, n)."""
    best = near_words(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    out = counted.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")))
    out = table(out.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of documents, each with its form and root."""
    return variants(table(words(docs), "words"))
