"""Near-duplicates by similarity of word shingles: an exact join by rare shingles, verified on whole texts.

A text is the set of its distinct shingles; texts of equal sets are one class. All shingles are put in one order, those
that the fewest classes hold first. Two sets of a Jaccard similarity of SIMILAR or more have a shingle in common among
the first n - ceil(SIMILAR * n) + 1 of each, n being its size (its prefix), so the classes that share a shingle of
their prefixes, a bucket, hold every pair that is similar enough, whatever its similarity and whoever else is near.
Shingles of one class alone are in no bucket, so most texts, whose prefix is made of such, meet nobody; most of those
are told by their first shingles in the order of the hashes before any shingle is counted for the order (`sharers`). The first
shingle that two sets share also bounds what they can share after it (`possible`), which spares most comparisons.

Pairs are compared in two rounds. First all pairs of a bucket of up to SMALL classes; of a larger one the pairs of
each class with the CENTRES that have the fewest rarer shingles, so are the most like all others, and, for chains of
versions, the least spanning forest of its 64-bit SimHash fingerprints (`bucket_links`). What the verified links join
needs no more comparison. Then, in the larger buckets, every pair that may be similar enough and is
not joined yet (`rest`); a bucket with more than BLOCK classes is dealt out by pairs of its parts. So no link that
joins two groups is left out, and copies and large groups of near copies make no pairs of all with all. Texts that
share rare shingles, may be similar by their sizes and are not are compared pair by pair; an exact answer needs that.

A link stays if the distinct shingles of the two whole texts have a Jaccard similarity of SIMILAR or more. Components
of the verified links are the groups. The links of a text that has more than 1/HOT of them are compared in SALTS parts.
The numbers of classes of shingles count up to MANY and are equal beyond, which bounds what a task holds of a shingle.

Defined results: null and empty texts, and texts of white space, have no shingle and form one group; a text of fewer
words than a shingle is one shingle; of each group one row stays, that with the least doc_id, then the least hash of
its text, null ids last; equal rows count as one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_key
from .simhash import components

SHINGLE = 5
SIMILAR = 0.8
LEAST_BITS = 26
DIFFER = 0.155
RECALL = 0.94
LIKELY = 20
HOT = 1000
SALTS = 16
CHUNK = 8192
SMALL = 16
CENTRES = 2
BLOCK = 1024
MANY = 1 << 20
FEW = 100_000
SLACK = 1 - 1e-9
KNOWN_WORDS = 200_000
ROWS_AT_ONCE = 4096
_SEEDS = np.random.default_rng(5).integers(0, 2**64, 96, dtype=np.uint64)
_PLACES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shape(rows: int) -> tuple[int, int]:
    """(bits of a block, number of blocks) with which ball hashing finds a pair of similarity 0.8 with a chance of RECALL.

    For tables of so many rows; `groups` is exact and does not use it.
    """
    bits = max(LEAST_BITS, rows.bit_length())
    meets = sum(comb(bits, d) * DIFFER**d * (1 - DIFFER) ** (bits - d) for d in range(3))
    return bits, ceil(log(1 - RECALL) / log(1 - meets))


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 42)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles; A-Z are lower-cased, words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.full(n, len(w) if len(w) < shingle else 0, np.uint64)
    for i in range(min(shingle, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(mixed(h))


def wide_fingerprint(grams: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` SimHash bits of a set of shingle hashes, or a few more, as 0 and 1."""
    seeds = _SEEDS[: -(-bits // 64)]
    ones = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(grams), ROWS_AT_ONCE):
        part = mixed(grams[at : at + ROWS_AT_ONCE, None] ^ seeds[None, :])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return (2 * ones > len(grams)).astype(np.uint8)


def forest(fps: np.ndarray, limit: int = LIKELY) -> tuple[list[int], list[int]]:
    """Links (positions) of the least spanning forest of distinct fingerprints, over differences of at most ``limit`` bits.

    Equal differences are told apart by a hash of the pair, so that the trees of the many buckets of one group agree.
    """
    left = np.arange(1, len(fps))
    near, owner = np.full(len(left), 2**64 - 1, np.uint64), np.zeros(len(left), np.int64)
    a, b, here = [], [], 0
    while len(left):
        differ = fps[left] ^ fps[here]
        d = (np.bitwise_count(differ).astype(np.uint64) << np.uint64(56)) | (mixed(differ) >> np.uint64(8))
        closer = d < near
        near[closer], owner[closer] = d[closer], here
        at = int(near.argmin())
        if int(near[at]) >> 56 <= limit:
            a.append(int(left[at]))
            b.append(int(owner[at]))
        here = int(left[at])
        keep = np.arange(len(left)) != at
        left, near, owner = left[keep], near[keep], owner[keep]
    return a, b


def bucket_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree links between the fingerprints that met in one variant."""
    fps = np.unique(fps)
    out_a, out_b, carried = [], [], np.empty(0, np.uint64)
    for at in range(0, len(fps), CHUNK):
        part = np.concatenate([carried, fps[at : at + CHUNK]])
        a, b = forest(part)
        out_a.append(part[a])
        out_b.append(part[b])
        carried = np.delete(part, a)  # the first class of every tree
    return np.concatenate(out_a), np.concatenate(out_b)


def possible(n_x: np.ndarray, at_x: np.ndarray, n_y: np.ndarray, at_y: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets of n_x and n_y shingles can be similar enough if the first that they share stands at those places."""
    return np.minimum(n_x - at_x, n_y - at_y) >= similar / (1 + similar) * SLACK * (n_x + n_y)


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sorted rows as columns, no group of the first ``keys`` columns cut, and the place where the group of each row begins."""
    held = None
    for batch in batches:
        part = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, part)] if held else part
        if not len(held[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in held[:keys]])
        last = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if last:
            yield _begun([c[:last] for c in held], keys)
            held = [c[last:] for c in held]
    if held and len(held[0]):
        yield _begun(held, keys)


def _begun(columns: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])
    return columns, np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(len(new) + 1), 0))


def all_pairs(begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of places in one group, by their distance. begins: where the group of each place begins, ascending."""
    at, far = np.arange(len(begins)), 1
    while True:
        at = at[at + far < len(begins)]
        at = at[begins[at + far] == begins[at]]
        if not len(at):
            return
        yield at, at + far
        far += 1


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def row_keys(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, class (hash of the set of shingles), n (their number) and fp (64 SimHash bits, long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        hashes = WordHashes()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                grams = shingles(text.as_py(), hashes, shingle)
                fp = (wide_fingerprint(grams, 64)[:64] * _PLACES).sum(dtype=np.uint64)
                found.append((xxh64_intdigest(grams.tobytes(), 42), len(grams), int(fp)))
            classes, sizes, fps = np.array(found, np.uint64).reshape(-1, 3).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, (classes, sizes, fps))], ["doc_id", "text_hash", "class", "n", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(hashed, f"doc_id {kind}, text_hash long, class long, n long, fp long")


def shared(texts: DataFrame, shingle: int = SHINGLE, similar: float | None = None) -> DataFrame:
    """(gram, class, n, share): shingles that several texts have, and how many do. texts: text_hash and text, one row each.

    ``class`` is the text_hash, ``n`` the number of its shingles. With ``similar`` only the first shingles of each text by
    their hashes are taken: n - ceil(similar * n), and a quarter of similar * n more.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for name, text in zip(batch.column("text_hash").to_pylist(), batch.column("text")):
                grams = shingles(text.as_py(), hashes, shingle).view(np.int64)
                n = len(grams)
                taken = n if similar is None else n - ceil(similar * SLACK * n) + ceil(similar * SLACK * n / 4)
                for at in range(0, taken, MANY):
                    part = grams[at : min(taken, at + MANY)]
                    yield pa.record_batch({"gram": part, "class": np.full(len(part), name, np.int64), "n": np.full(len(part), n, np.int64)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows have each gram, up to MANY; rows alone with theirs go."""
        held, often = None, []
        for batch in batches:
            part = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, part)] if held else part
            if not len(held[0]):
                continue
            gram = held[0][-1]
            last = int(np.searchsorted(held[0], gram))
            if len(held[0]) - last >= MANY or gram in often[-1:]:  # of a gram that has so many rows none is held back
                often, last = [*often, gram], len(held[0])
            yield rows([c[:last] for c in held], often)
            held, often = [c[last:] for c in held], often[-1:]
        if held and len(held[0]):
            yield rows(held, often)

    def rows(columns: list[np.ndarray], often: list[int]) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]])) if len(columns[0]) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([heads, [len(columns[0])]]))
        share = np.minimum(np.repeat(sizes, sizes), MANY)
        share[np.isin(columns[0], often)] = MANY
        keep = share > 1
        return pa.record_batch([pa.array(c[keep]) for c in (*columns, share)], ["gram", "class", "n", "share"])

    dealt = texts.select("text_hash", "text").mapInArrow(split, "gram long, class long, n long").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(counted, "gram long, class long, n long, share long")


def sharers(texts: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """class: the texts that may have a similar one, by their first shingles alone.

    Of what two similar sets share, the first k stand in the first n - ceil(similar * n) + k of both. k is a quarter of
    similar * n for the smaller set, which has at least similar times as many shingles as the other.
    """
    counts = shared(texts, shingle, similar).groupBy("class", "n").count()
    return counts.filter(F.col("count") >= F.ceil(F.col("n") * (similar * similar / 4 * SLACK))).select("class")


def prefixes(texts: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """(gram, class, n, at): the shingles of every prefix that another text has too; ``at`` is the place in the common order."""
    # Counted from the end, so that the shingles that no other text has, which come first, are not needed.
    from_end = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("share"), F.desc("gram")))
    ranked = shared(texts, shingle).withColumn("from_end", from_end)
    return ranked.filter(F.col("from_end") >= F.ceil(F.col("n") * (similar * SLACK))).select("gram", "class", "n", (F.col("n") - F.col("from_end")).alias("at"))


def candidates(prefix: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """First links (a, b) between the classes of each bucket: all possible ones of small buckets, those with centres and tree links of others.

    prefix: as `prefixes` gives it, with the fingerprint fp of each class.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, name, n, at, fps), begins in _whole(batches, 1):
            large = np.bincount(begins, minlength=len(begins))[begins] > SMALL
            small = np.flatnonzero(~large)
            for x, y in all_pairs(begins[small]):
                x, y = small[x], small[y]
                near = possible(n[x], at[x], n[y], at[y], similar)
                yield _links(name[x[near]], name[y[near]])
            for head in np.unique(begins[large]):
                here = np.flatnonzero(begins == head)
                distinct, first, of = np.unique(fps[here].view(np.uint64), return_index=True, return_inverse=True)
                a, b = bucket_links(distinct)
                centres = here[np.lexsort((name[here], at[here]))][:CENTRES]
                x = np.concatenate([here[first[np.searchsorted(distinct, a)]], here, np.tile(here, len(centres))])
                y = np.concatenate([here[first[np.searchsorted(distinct, b)]], here[first[of]], np.repeat(centres, len(here))])
                near = possible(n[x], at[x], n[y], at[y], similar) & (x != y)
                yield _links(name[x[near]], name[y[near]])

    dealt = prefix.select("gram", "class", "n", "at", "fp").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def rest(prefix: DataFrame, roots: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """All possible links (a, b) of the buckets that are not small, between classes of different roots (node, root)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j, part, name, n, at, root), begins in _whole(batches, 3):
            for x, y in all_pairs(begins):
                near = (root[x] != root[y]) & ((i[x] == j[x]) | (part[x] != part[y])) & possible(n[x], at[x], n[y], at[y], similar)
                if near.any():
                    yield _links(name[x[near]], name[y[near]])

    rooted = prefix.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = rooted.groupBy("gram").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).filter((F.col("rows") > SMALL) & (F.col("low") != F.col("high")))
    parts = open_.select("gram", F.ceil(F.col("rows") / BLOCK).cast("long").alias("parts"))
    parted = rooted.join(parts, "gram").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = parted.select("gram", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "n", "at", "root")
    return dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(meet, "a long, b long").distinct()


def verified(links: DataFrame, texts: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The links (a, b) between text hashes whose texts are similar enough. texts: text_hash and text, one row each."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            stays, last, grams = [], None, None
            for b, x, y in zip(batch.column("b"), batch.column("text_a"), batch.column("text_b")):
                if b != last:
                    last, grams = b, shingles(y.as_py(), hashes, shingle)
                other = shingles(x.as_py(), hashes, shingle)
                both = len(np.intersect1d(grams, other, assume_unique=True))
                every = len(grams) + len(other) - both
                stays.append(both >= similar * every)
            yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    # The links are the smaller side by far: hashed, so that no text is sorted.
    total = links.count()
    parts = {}
    for side in "ab":
        often = links.groupBy(F.col(side).alias("text_hash")).count().filter(F.col("count") * HOT > total + HOT * SALTS)
        hot = F.broadcast(often.select("text_hash", F.lit(SALTS).alias("parts")))  # fewer than HOT rows, whatever the data
        parted = texts.join(hot, "text_hash", "left").select("text_hash", "text", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        parts[side] = parted.select(F.col("text_hash").alias(side), F.col("text").alias(f"text_{side}"), F.col("salt").alias(f"salt_{side}"))
        salt = F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")), F.lit(0)).cast("int").alias(f"salt_{side}")
        links = links.join(hot.withColumnRenamed("text_hash", side), side, "left").select(*[c for c in links.columns if c != side], side, salt)
    first = parts["a"].join(links.hint("shuffle_hash"), ["a", "salt_a"])
    second = parts["b"].join(first.hint("shuffle_hash"), ["b", "salt_b"])
    return second.select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long")


def _once(rows: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """One row of each key; where no row of the input is repeated there is nothing to do."""
    return rows.dropDuplicates(keys) if repeated else rows


def _with_keys(documents: DataFrame) -> DataFrame:
    """The documents in a struct ``row`` with what tells different ones apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    return documents.select(row, doc_key(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def _texts(documents: DataFrame, classes: DataFrame, repeated: bool, few: bool = False) -> DataFrame:
    """text_hash (the class) and text of one row of each class. few: so few classes that they may be broadcast."""
    rows = documents.select(doc_key(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = classes.select(doc_key(), F.col("text_hash").alias("of"), F.col("class").alias("text_hash"))
    return _once(rows.join(wanted.hint("broadcast" if few else "shuffle_hash"), ["__doc", "of"]).select("text_hash", "text"), ["text_hash"], repeated)


def groups(documents: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, bool]:
    """(distinct texts with text_hash, class and their least row, roots of classes in groups of several: node, root, whether rows are repeated)."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    same = [F.first(c).alias(c) for c in ("class", "n", "fp")]
    by_row = row_keys(documents, shingle).groupBy("text_hash", "doc_id").agg(F.count("*").alias("rows"), *same)
    distinct = cut(by_row.groupBy("text_hash").agg(F.min(row).alias("least"), F.max("rows").alias("rows"), *same))
    repeated = bool((distinct.agg(F.max("rows")).first()[0] or 0) > 1)
    classes = distinct.groupBy("class").agg(F.min(F.struct("text_hash", "least.doc_id", "fp")).alias("of")).select("class", "of.*")

    def near(links: DataFrame) -> DataFrame:
        nodes = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).distinct()
        named = cut(classes.join(nodes, "class", "left_semi"), narrow=True)
        return verified(links, _texts(documents, named, repeated, named.count() <= FEW), similar, shingle)

    some = cut(classes.join(sharers(_texts(documents, classes, repeated), similar, shingle), "class", "left_semi"), narrow=True)
    prefix = cut(prefixes(_texts(documents, some, repeated, some.count() <= FEW), similar, shingle).join(some.select("class", "fp"), "class"))
    first = cut(candidates(prefix, similar), narrow=True)
    roots = components(near(first))
    more = cut(rest(prefix, roots, similar).join(first, ["a", "b"], "left_anti"), narrow=True)
    if not more.isEmpty():
        roots = components(near(more).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return distinct, roots, repeated


def one_of_each(documents: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: one row of each group."""
    distinct, roots, repeated = groups(documents, similar, shingle)
    rooted = distinct.join(roots, F.col("class") == F.col("node"), "left").select(F.coalesce("root", "class").alias("root"), "least")
    stays = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("doc_id"), F.col("least.text_hash").alias("text_hash")).select(doc_key(), "text_hash")
    kept = _once(_with_keys(documents).join(stays.hint("shuffle_hash"), ["text_hash", "__doc"], "left_semi"), ["text_hash", "__doc"], repeated)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
