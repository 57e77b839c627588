"""N-gram Jaccard self-join by parity sketches.

A text's set is its distinct shingles. Each shingle is hashed to one word of a
sketch and XORed into it, so that the words in which two sketches differ are at
most the shingles in which two sets differ. Two sets that link differ in at most
D shingles, where D follows from the sizes of a size band; with more than D words
some word must agree, so sketches are joined word by word within a band
(pigeonhole). A second parity sketch of single bits prunes candidates by Hamming
distance, a third one that grows with the set prunes those of large sets, and
what is left is verified on the sets themselves. Where it departs from a plain bit
sketch: the pigeons are 64-bit XORs, not bits, as a bit agrees by chance and an
XOR does not, so buckets stay small.

Equal sets are collapsed first. In a bucket of equal words only the pairs with
its smallest member are made; a word that is frequent in a task has a bucket of
its own there, so no bucket grows with the largest group. A second pass takes the
words whose members did not all end in one component and makes their missing
pairs, so no link is lost and large groups of copies cost no more than their
size. Before that, texts leave it that have too many shingles which no other text
of the second pass has: these are in no intersection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import kernel

U = np.uint64
#: Longs of the pruning sketch; one bit for each shingle.
PRUNE = 16
#: Bits of the growing sketch for each shingle in which sets that link may differ, at least.
FINE = 8
#: Words by which a pair that shares several buckets is told from itself.
FIRST_WORDS = 32
#: Ratio of the size bands.
BAND = 1.6
#: A set of at most so many ids may be broadcast.
BROADCAST_IDS = 1_000_000
#: Pairs of one set that are verified together: the set is sent once for so many.
CHUNK = 64
#: A task takes a word for frequent after so many texts with it, of those that share their batch with another.
FREQUENT = 16
#: Frequent words that a task keeps.
KEPT_WORDS = 100_000


def bands(num: int, den: int, upto: int) -> Iterator[tuple[int, int, int]]:
    """(smallest size, largest size, D) of each band that has sizes up to upto: every linking pair of unequal sets is in the band of its smaller set.

    Sets link if the intersection is at least num / den of the union, so sizes a <= b have b <= a * den / num and differ in at most
    (a + b) * (den - num) / (den + num) shingles.
    """
    low = 1
    while low <= upto:
        high = max(low, int(low * BAND) - 1)
        most = high * den // num
        yield low, most, (high + most) * (den - num) // (den + num)
        low = high + 1


def slack(d: int) -> int:
    """Words of a sketch beyond D + 1. A text with no more empty words than this leaves them out, as then some word that is not empty agrees too."""
    return 4 + d // 12


def cells(x: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of m to which each shingle hash of x is dealt, and what it is mixed to."""
    y = kernel.mix(x + U((2 * seed + 1) * int(kernel.BASE) % 2**64))
    return ((y >> U(32)) * U(m) >> U(32)).astype(np.int64), y


def sketch_words(x: np.ndarray, m: int, seed: int) -> np.ndarray:
    """The m words of the sketch of shingle hashes x: XOR of the hashes dealt to each; 0 is an empty word."""
    at, y = cells(x, m, seed)
    order = np.argsort(at, kind="stable")
    out = np.zeros(m, U)
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] = np.bitwise_xor.reduceat(kernel.mix(y[order]), first)
    return out


def least_shared(x: np.ndarray, table: list[tuple[int, int, int]]) -> int:
    """Words that a text shares with each text that it links with, at least, in the band that has fewest: all but D agree, and either text may have left out empty ones."""
    least = 0
    for j, (low, most, d) in enumerate(table):
        if low <= len(x) <= most and d > 0:
            m = d + 1 + slack(d)
            empty = m - np.count_nonzero(np.bincount(cells(x, m, j)[0], minlength=m))
            need = m - d - min(empty, slack(d))
            least = min(least or need, need)
    return max(1, least)


def bands_upto(table: list[tuple[int, int, int]], n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """table if it has all bands of size n, else a longer one."""
    return table if table[-1][0] >= n else list(bands(num, den, 2 * n))


def prune_bits(x: np.ndarray) -> np.ndarray:
    """PRUNE longs with the parity of the shingles dealt to each bit."""
    bit = np.bincount((kernel.mix(x ^ U(0x5851F42D4C957F2D)) >> U(64 - (PRUNE * 64 - 1).bit_length())).astype(np.int64), minlength=PRUNE * 64) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").view(np.int64)


def fine_bits(x: np.ndarray, num: int, den: int) -> bytes:
    """Parity of the shingles dealt to each of 64 * 2^i bits, FINE times the shingles that may differ or more. Halves XORed are the sketch of half as many bits."""
    bits = max(64, 1 << (FINE * 2 * len(x) * (den - num) // (den + num)).bit_length())
    at = (kernel.mix(x ^ U(0x9FB21C651E98DF25)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fine_differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two growing sketches differ, the longer one folded: at most the shingles in which the sets differ."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    kernel.release()
    for _, _, data, offsets in kernel.groups(texts):
        start, end, at = kernel.words(data, offsets)
        h = kernel.span_hashes(data, start, end, kernel.LOWER)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(kernel.shingles(h[a:b], k))


PROFILE = "id long, n long, need long, h1 long, h2 long, " + ", ".join(f"s{i} long" for i in range(PRUNE)) + ", fine binary"


def profiles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, n (set size), need (as least_shared), h1 and h2 (the set's identity), s0.. (pruning sketch), fine (growing sketch) for each row of docs (id, text)."""

    def run(batches):
        table = list(bands(num, den, 1))
        for b in batches:
            rows, fine = [], []
            for x in sets(b.column("text"), k):
                table = bands_upto(table, len(x), num, den)
                fine.append(fine_bits(x, num, den))
                y = kernel.mix(x ^ U(0xD6E8FEB86659FD93))
                rows.append(np.concatenate([np.array([len(x), least_shared(x, table)], np.int64), np.array([np.add.reduce(x), np.bitwise_xor.reduce(y)], U).view(np.int64), prune_bits(x)]))
            m = np.stack(rows) if rows else np.empty((0, PRUNE + 4), np.int64)
            names = ["id", "n", "need", "h1", "h2", *[f"s{i}" for i in range(PRUNE)], "fine"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(m.shape[1])], pa.array(fine, pa.binary())], names)

    return docs.mapInArrow(run, PROFILE)


class Frequent:
    """Deals the texts of words that are frequent in this task to buckets of the task, which the first text with the word ties to the others."""

    def __init__(self, bucket: int):
        self.bucket = bucket
        self.count: dict[int, int] = {}
        self.first: dict[int, int] = {}

    def deal(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words, bucket (0: the common one), ids; rows may be added."""
        bucket = np.zeros(len(words), np.int64)
        if len(self.count) > KEPT_WORDS:
            self.count.clear()
            self.first.clear()
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(np.append(heads, len(words)))
        frequent = np.array(list(self.first), U)
        frequent.sort()
        at = np.minimum(np.searchsorted(frequent, ordered[heads]), max(0, len(frequent) - 1))
        known = frequent[at] == ordered[heads] if len(frequent) else np.zeros(len(heads), bool)
        more_words, more_ids = [], []
        for h, n, old in zip(heads[(sizes > 1) | known].tolist(), sizes[(sizes > 1) | known].tolist(), known[(sizes > 1) | known].tolist(), strict=True):
            word, rows = int(ordered[h]), order[h : h + n]
            if old:
                bucket[rows] = self.bucket
                continue
            self.count[word] = self.count.get(word, 0) + n
            if self.count[word] >= FREQUENT:
                self.first[word] = int(ids[rows[0]])
                more_words.append(word)
                more_ids.append(self.first[word])
                bucket[rows[1:]] = self.bucket
        return np.concatenate([words, np.array(more_words, U)]), np.concatenate([bucket, np.full(len(more_words), self.bucket)]), np.concatenate([ids, np.array(more_ids, np.int64)])


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """word, bucket, id: the sketch words of each text in each band of its size. A set seen before in the same partition is left out: its first text stands for it.

    bucket parts the texts of a word that is frequent in a task; texts of one word in different buckets are tied by a text that is in both.
    """

    def run(batches):
        seen: set[tuple[int, int, int]] = set()
        frequent = Frequent(TaskContext.get().partitionId() + 1)
        table = list(bands(num, den, 1))
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            keys, owners = [], []
            for i, x in zip(ids, sets(b.column("text"), k), strict=True):
                n = len(x)
                if not n:
                    continue
                name = (n, int(np.add.reduce(x)), int(np.bitwise_xor.reduce(kernel.mix(x))))
                if name in seen:
                    continue
                if len(seen) > 200_000:  # only saves work: copies that are missed here meet in their buckets
                    seen.clear()
                seen.add(name)
                table = bands_upto(table, n, num, den)
                for j, (low, most, d) in enumerate(table):
                    if low <= n <= most and d > 0:
                        w = sketch_words(x, d + 1 + slack(d), j)
                        full = w != 0
                        place = np.arange(len(w), dtype=U) + U(j << 40)
                        if len(w) - full.sum() <= slack(d):
                            w, place = w[full], place[full]
                        keys.append(kernel.mix(w + kernel.mix(place)))
                        owners.append(np.full(len(w), i))
            if keys:
                words, bucket, ids = frequent.deal(np.concatenate(keys), np.concatenate(owners).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bucket), pa.array(ids)], ["word", "bucket", "id"])

    return docs.mapInArrow(run, "word long, bucket long, id long")


def refined(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the growing sketches of known (id, n, fine) allow."""
    one, two = (known.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("fine").alias(f"f{i}")) for i in ("a", "b"))

    def compare(batches):
        for b in batches:
            good = []
            for n, o, x, y in zip(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")), b.column("fa"), b.column("fb"), strict=True):
                d = fine_differing(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U))
                good.append(d * (den + num) <= (int(n) + int(o)) * (den - num))
            b = b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            if b.num_rows:
                yield b

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(compare, "a long, b long").distinct()


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id is in ids."""
    return docs.join(C.small(ids, BROADCAST_IDS), "id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link. The sets of the texts in any pair are computed again, once; that of b goes to its pairs, that of a once to each CHUNK of its pairs."""
    pairs = C.stored(pairs, "pairs")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    partners = pairs.join(chunks, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"))
    hubs = chunks.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"))
    sends = C.stored(hubs.unionByName(partners), "sends")

    def sets_with_ids(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in sets(b.column("text"), k)], pa.binary())], ["id", "set"])

    found = of_ids(docs, C.stored(sends.select("id").distinct(), "ids")).mapInArrow(sets_with_ids, "id long, set binary")
    # A hub's set stands before those of its partners.
    met = found.join(C.small(sends, BROADCAST_IDS), "id").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "kind")

    def compare(batches):
        now, own = None, {}
        for b in batches:
            good = []
            for hub, chunk, kind, i, value in zip(*(b.column(c).to_pylist() for c in ("hub", "chunk", "kind", "id")), b.column("set"), strict=True):
                if now != (hub, chunk):
                    now, own = (hub, chunk), {}
                y = np.frombuffer(value.as_buffer(), U)
                if not kind:
                    own[len(y), int(np.add.reduce(y)), int(np.bitwise_xor.reduce(kernel.mix(y)))] = y.copy()
                    continue
                for x in own.values():
                    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                        continue
                    z = np.concatenate([x, y])
                    z.sort()
                    both = int((z[1:] == z[:-1]).sum())
                    if den * both >= num * (len(x) + len(y) - both):
                        good.append((hub, i))
                        break
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good, strict=True)], ["a", "b"])

    return met.select("hub", "chunk", "kind", "id", "set").mapInArrow(compare, "a long, b long").distinct()


@C.tidy
def sharing(docs: DataFrame, known: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id of the texts of known (id, n) that may link with another text of known: at least num / den of their shingles are in one more of these texts.

    A shingle that only one of the texts has is in no intersection. Shingles are counted by partial sums; what returns to a text is the number of
    those that it has alone. An id with several texts stays if it may for the smallest of them.
    """
    known = C.stored(known.groupBy("id").agg(F.sum("n").alias("n"), F.min("n").alias("least")), "sharing")

    def run(batches):
        for b in batches:
            ids, some = b.column("id").to_numpy(zero_copy_only=False), []
            for i, x in enumerate(sets(b.column("text"), k)):
                some.append(x.view(np.int64))
                if len(some) == 32 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(np.repeat(ids[i + 1 - len(some) : i + 1], [len(x) for x in some]))], ["shingle", "id"])
                    some = []

    shingles = of_ids(docs, known.select("id")).mapInArrow(run, "shingle long, id long")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("id").alias("id")).where("texts = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return known.join(alone, "id", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * den >= F.col("least") * num).select("id")


@C.tidy
def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable by edges (a, b), for every id but the smallest ones themselves; never in one task."""
    from lamella.operators.components import star_components  # not above: Python workers import this module, and they need no pandas

    return star_components(edges, one_task=0).withColumnRenamed("root", "component")


def differing(a: str, b: str) -> Column:
    """Bits in which two pruning sketches differ: at most the shingles in which the sets differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(PRUNE)))


def possible(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and pruning sketches allow a link."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * den >= large * num) & (differing(a, b) * (den + num) <= (small + large) * (den - num))


class Sketched:
    """What the passes of a join share: known (sizes and sketches of all rows), whose (each id with the smallest id of its set), same (edges of copies), buckets."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, num: int, den: int):
        self.spec = (words, num, den)
        C.short_batches(docs.sparkSession)
        given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        self.known = C.stored(profiles(given, words, num, den), "profiles")
        self.named = given.where("id is not null")
        set_of = ["n", "h1", "h2"]
        some = self.known.where("n > 0 and id is not null")
        # Sets of several ids are few; stored, they meet their ids in a join that Spark can split where one set has very many.
        copies = some.groupBy(*set_of).agg(F.min("id").alias("rep"), F.max("id").alias("other")).where("rep < other").drop("other")
        copies = C.stored(copies, "copies")
        # Each id with the smallest id of its set. Sizes and sketches travel with it.
        whose = some.join(copies, set_of, "left").select("id", F.coalesce("rep", "id").alias("rep"), "n", "need", *[f"s{i}" for i in range(PRUNE)])
        self.whose = C.stored(whose.distinct(), "sets")
        self.same = self.whose.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        # Buckets with two members or more. Copies stand for their set once they are looked up below.
        one = Window.partitionBy("word", "bucket")
        buckets = signatures(self.named, words, num, den).withColumn("lead", F.min("id").over(one)).withColumn("members", F.count("*").over(one))
        self.buckets = C.stored(buckets.where("members > 1").drop("members"), "buckets")

    def linking(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        words, num, den = self.spec
        return verified(self.named, refined(pairs, self.known, num, den), words, num, den)

    def stars(self) -> DataFrame:
        """Pairs of set representatives: each bucket's smallest member with the others."""
        _, num, den = self.spec
        pairs = self.buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        pairs = pairs.alias("p").join(self.whose.alias("l"), F.col("p.a") == F.col("l.id")).join(self.whose.alias("r"), F.col("p.b") == F.col("r.id"))
        pairs = pairs.where(F.col("l.rep") != F.col("r.rep")).where(possible("l", "r", num, den))
        return pairs.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()

    def within(self, members: DataFrame, apart: Column) -> DataFrame:
        """Pairs of set representatives that share a word, of members (word, bucket, id, lead, ...) l and r for which apart holds, pruned inside of the join.

        A pair meets in every word that it shares; it is made in the first one, as far as the first words of both tell, else in each.
        """
        _, num, den = self.spec
        first = members.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("word")), 1, FIRST_WORDS).alias("first"))
        members = C.stored(members.join(first, "id").join(self.whose, "id"), "open")
        l, r = members.alias("l"), members.alias("r")
        here = F.coalesce(F.array_min(F.array_intersect("l.first", "r.first")), F.col("l.word")) == F.col("l.word")
        pairs = l.join(r, (F.col("l.word") == F.col("r.word")) & apart & possible("l", "r", num, den) & here)
        return pairs.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).where("a <> b").distinct()


def mixed(members: DataFrame) -> DataFrame:
    """The members (word, component, ...) of words whose members are in different components; two members alone are a pair that was tried."""
    words = members.groupBy("word").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y and n > 2").select("word")
    return members.join(words, "word", "left_semi")


@C.tidy
def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component for each row of docs: the smallest id reachable by links, itself included.

    Two texts link if their sets of distinct shingles of so many words (A-Z lower-cased; with fewer words the whole sequence is the one
    shingle) share at least num / den of their union. Shingles are compared by 64-bit hash. Only components are found: of the links inside of one,
    as many as it takes; links() finds all.
    Results: a null or empty text has no shingles and links with nothing; rows with the same id are one node with the links of all of them;
    rows with a null id keep n_shingles, link with nothing and have a null component; an id that is no integer fails the cast; an empty table
    gives no rows. Other columns are ignored.
    """
    t = Sketched(docs, key, text, words, num, den)
    edges = C.stored(t.linking(t.stars()).unionByName(t.same), "links")
    found = components(edges)

    # Words whose members are in different components: their pairs that were not tried.
    members = C.stored(t.buckets.join(found, "id", "left").select("word", "bucket", "id", "lead", F.coalesce("component", "id").alias("component")), "members")
    open_ = mixed(members)
    enough = open_.groupBy("id").agg(F.countDistinct("word").alias("words")).join(t.whose.groupBy("id").agg(F.min("need").alias("need")), "id").where("words >= need").select("id")
    open_ = C.stored(mixed(open_.join(enough, "id")).join(t.whose.select("id", "rep").distinct(), "id"), "apart")
    texts = t.whose.select(F.col("id").alias("rep"), "n").join(open_.select("rep").distinct(), "rep").select(F.col("rep").alias("id"), "n")
    stay = C.stored(sharing(t.named, texts, words, num, den), "stay")
    open_ = mixed(open_.join(C.small(stay.select(F.col("id").alias("rep")), BROADCAST_IDS), "rep", "left_semi").drop("rep").distinct())
    tried = (F.col("l.bucket") == F.col("r.bucket")) & ((F.col("l.id") == F.col("l.lead")) | (F.col("r.id") == F.col("r.lead")))
    rest = t.within(open_, (F.col("l.component") < F.col("r.component")) & ~tried)
    more = C.stored(t.linking(rest), "more")
    if more.limit(1).count():
        found = components(edges.unionByName(more))
    return t.known.join(found, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


@C.tidy
def links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) with a < b between set representatives, and the membership (id, rep) of each row with a set and an id.

    The representative of a set is its smallest id; equal sets are linked by membership alone. The pairs of a group of near copies are as many as
    it has, so they grow with the square of its size; link() does without them. Results: as in link().
    """
    t = Sketched(docs, key, text, words, num, den)
    return t.linking(t.within(t.buckets, F.col("l.id") < F.col("r.id"))), t.whose.select("id", "rep").distinct()


@C.tidy
def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest id (repeated rows all), and all rows with a null id. Columns stay as they are."""
    out = link(docs, key=key, text=text, **options)
    gone = C.stored(out.where("component <> id").select("id").distinct(), "gone")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"))
    return row.join(C.small(gone, BROADCAST_IDS), "id", "left_anti").select("row.*")
