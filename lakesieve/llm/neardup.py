"""Problem 1: near-duplicate records with small edits, by a grouped prefix join.

Method. Documents with the same word set collapse into one set. Every set gets prefixes under several token orders
(``signatures.prefixes``), so that similar sets share at least one whole prefix. Sets with an identical prefix and
an identical size form one group. Pairs of groups with the same prefix are filtered by their sizes; those that are
left are expanded to pairs of members, filtered by the parity maps of the word sets and verified on the words
themselves.

Why several orders and not one rarest-first prefix: on a bounded vocabulary even the rarest words of a text are
frequent, so one order's candidates grow with the square of the corpus at once. A whole prefix of about seven words
is rarer, but still frequent in a large enough corpus: a prefix that more than HOT sets have is lengthened by one
more block of words (``wide``), which finds all similar sets again. What is still shared by very many sets is shared
by sets with much in common, whose pairs are mostly results; their groups are cut into chunks that are paired in
separate cells, so no task gets them all. How many sets have a prefix is estimated from every SAMPLE-th set, chosen
by hash; that decides how a prefix is worked on, never whether a pair is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm import signatures as S
from lakesieve.llm.verify import jaccard, with_texts
from lakesieve.session import materialize

_SCHEMA = "id long, set_id long, size int, parity int, keys array<long>, wide array<int>"
#: One set in SAMPLE tells how many have a prefix; prefixes of more than HOT sets are lengthened; members of a chunk.
SAMPLE, HOT, CHUNK = 8, 32, 512


def _signer(threshold: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, classes, seen = S.WordHasher(), S.SizeClasses(threshold, min_words), set()
        for batch in batches:
            hashes, counts = hasher.flat(batch.column(1).to_pylist())
            enough = counts >= min_words
            if not enough.any():
                continue
            hashes = hashes[np.repeat(enough, counts)]
            counts = counts[enough]
            ids = batch.column(0).filter(pa.array(enough))
            set_ids = S.set_hash(hashes, counts).view(np.int64)
            parity = S.parity_map(hashes, counts, 32).astype(np.uint32).view(np.int32)
            # A set needs its keys once per task: repeated copies send their membership only.
            if len(seen) > S.CACHE_WORDS:
                seen.clear()
            new = np.zeros(len(counts), bool)
            for i, s in enumerate(set_ids.tolist()):
                if s not in seen:
                    seen.add(s)
                    new[i] = True
            rows = np.flatnonzero(new)
            p = S.prefixes(hashes[np.repeat(new, counts)], counts[new], classes)
            # One row a document, and one more for every other class that a set takes part in.
            extra = np.flatnonzero(~p.own)
            of = np.concatenate([np.arange(len(counts)), rows[p.of[extra]]])
            n_keys, n_wide = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
            target = np.concatenate([rows, len(counts) + np.arange(len(extra))])
            n_keys[target], n_wide[target] = p.n_keys, p.n_wide
            no_id = pa.nulls(len(extra), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids.cast(pa.int64()), no_id]), pa.array(set_ids[of]), pa.array(counts[of].astype(np.int32)), pa.array(parity[of]),
                    S.list_array(p.keys, n_keys, pa.int64()), S.list_array(p.wide, n_wide, pa.int32()),
                ],
                ["id", "set_id", "size", "parity", "keys", "wide"],
            )

    return run


def signed(docs: DataFrame, id_col: str, text_col: str, threshold: float, min_words: int) -> DataFrame:
    """The signatures of every document of at least ``min_words`` words, materialised.

    (id, set_id, size, parity, keys, wide): one row a document, whose keys are empty for copies of a set seen before
    in the task, and one without id for a set's second size class.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return materialize(narrow.mapInArrow(_signer(threshold, min_words), _SCHEMA), "signed")


def members_of(sig: DataFrame) -> DataFrame:
    """(id, set_id) of every document."""
    return sig.where("id is not null").select("id", "set_id").distinct()


def _sampled(sig: DataFrame) -> DataFrame:
    return sig.where((F.size("keys") > 0) & (F.pmod(F.xxhash64("set_id"), F.lit(SAMPLE)) == 0))


def _common(keys: DataFrame) -> DataFrame:
    """(key, sets): an estimate of how many sets have a key, for the keys of more than HOT sets. keys: those of the sampled sets."""
    return materialize(keys.groupBy("key").agg((F.count("*") * SAMPLE).alias("sets")).where(F.col("sets") > HOT), "common")


def _postings(sig: DataFrame, common: DataFrame | None) -> DataFrame:
    """(key, set_id, size, parity): a ``common`` key is replaced by one for each of the set's wide blocks."""
    rows = sig.where(F.size("keys") > 0)
    if common is None:
        return rows.select("set_id", "size", "parity", F.explode("keys").alias("key"))
    each = rows.select("set_id", "size", "parity", "wide", F.explode("keys").alias("key")).join(common, "key", "left")
    longer = F.when(F.col("sets").isNotNull(), F.transform("wide", lambda w, i: F.xxhash64("key", i, w))).otherwise(F.array("key"))
    return each.select("set_id", "size", "parity", F.explode(longer).alias("key"))


def _lengthened(sig: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(postings, (key, sets) of the keys that many sets share even when lengthened)."""
    some = _sampled(sig)
    common = _common(_postings(some, None).select("key"))
    if common.isEmpty():
        return _postings(sig, None), None
    return _postings(sig, common), _common(_postings(some, common).select("key"))


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): the values first .. first + count - 1 of every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.repeat(first, count) + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))


def group_pairs(key: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(start, count, left, right) of rows sorted by key and size: the groups of equal key and size, and the pairs of
    groups (also of one of several members with itself) of one key whose sizes a similarity of ``t`` allows."""
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (size[1:] != size[:-1]))))
    count = np.diff(np.append(start, len(key)))
    keys, sizes = key[start], size[start]
    end = np.searchsorted(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), np.arange(len(keys)), side="right")
    ends = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys))[end]
    left, right = _expanded(np.arange(len(keys)), ends - np.arange(len(keys)))
    near = (sizes[left] >= t * sizes[right] - 1e-9) & ((left != right) | (count[left] > 1))
    return start, count, left[near], right[near]


#: Pairs of members that a task expands at a time.
AT_ONCE = 1 << 20


def _paired(threshold: float):
    """Rows (key, size, set_id, parity), sorted, to (set_a, set_b) of the pairs of one prefix."""

    def pairs(key: np.ndarray, size: np.ndarray, sid: np.ndarray, par: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))  # a set may come from several tasks
        key, size, sid, par = key[fresh], size[fresh], sid[fresh], par[fresh]
        start, count, left, right = group_pairs(key, size, threshold)
        many = count[left] * count[right]
        at = 0
        while at < len(left):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), AT_ONCE, side="right")) + at)
            row, cell = _expanded(np.zeros(upto - at, np.int64), many[at:upto])
            i, j = left[at:upto][row], right[at:upto][row]
            x, y = start[i] + cell // count[j], start[j] + cell % count[j]
            most = np.floor((1 - threshold) / (1 + threshold) * (size[x] + size[y]) + 1e-9)
            good = (x < y) & (np.bitwise_count((par[x] ^ par[y]).view(np.uint32)) <= most)
            yield sid[x[good]], sid[y[good]]
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            open_ = int(np.searchsorted(now[0], now[0][-1], side="left"))  # the last prefix may go on in the next batch
            rest = [c[open_:] for c in now]
            if open_:
                for x, y in pairs(*(c[:open_] for c in now)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["set_a", "set_b"])
        if len(rest[0]):
            for x, y in pairs(*rest):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["set_a", "set_b"])

    return run


def chunk_groups(placed: DataFrame) -> DataFrame:
    """(key, chunk, chunks, size, members): one row for the sets of a chunk with the same prefix and size."""
    return placed.groupBy("key", "chunk", "chunks", "size").agg(F.collect_set(F.struct("set_id", "parity")).alias("members"))


def _pairs_across_chunks(groups: DataFrame, threshold: float) -> DataFrame:
    """(set_a, set_b) of prefixes in chunks: a group meets those of its own chunk in the cell (chunk, chunk) and
    those of another in the cell (lower, higher)."""
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = groups.withColumn("other", other).select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "size", "members")
    a, b = cells.alias("a"), cells.alias("b")
    same_cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "low", "high")]
    first = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.chunk") <= F.col("b.chunk")))
    apart = (F.col("a.chunk") != F.col("b.chunk")) | (F.col("a.low") == F.col("a.high"))
    near = F.col("a.size") >= F.lit(threshold) * F.col("b.size") - F.lit(1e-9)
    pairs_of_groups = a.join(b, same_cell).where(first & apart & near).select(
        (F.col("a.size") + F.col("b.size")).alias("sizes"), ((F.col("a.size") == F.col("b.size")) & (F.col("a.chunk") == F.col("b.chunk"))).alias("one"), F.col("a.members").alias("ma"), F.col("b.members").alias("mb")
    )
    limit = F.floor(F.lit((1 - threshold) / (1 + threshold)) * F.col("sizes") + F.lit(1e-9))
    expanded = pairs_of_groups.select("one", "mb", limit.alias("limit"), F.explode("ma").alias("x")).select("one", "limit", "x", F.explode("mb").alias("y"))
    good = (~F.col("one") | (F.col("x.set_id") < F.col("y.set_id"))) & (F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) <= F.col("limit"))
    return expanded.where(good).select(F.least("x.set_id", "y.set_id").alias("set_a"), F.greatest("x.set_id", "y.set_id").alias("set_b"))


def candidate_pairs(sig: DataFrame, threshold: float) -> DataFrame:
    """(set_a, set_b): the pairs of members of group pairs that sizes and parity maps allow, each once.

    Sets with one prefix lie side by side, sorted by size, so groups are runs of rows. A prefix that very many sets
    share even when lengthened is cut into chunks by hash, whose groups are rows that meet in cells.
    """
    postings, common = _lengthened(sig)
    columns = ["key", "size", "set_id", "parity"]
    cut = None if common is None else common.select("key", F.ceil(F.col("sets") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    few = postings if cut is None else postings.join(cut, "key", "left_anti")
    together = few.select(*columns).repartition("key").sortWithinPartitions("key", "size", "set_id")
    pairs = together.select(F.col("key"), F.col("size").cast("long"), "set_id", "parity").mapInArrow(_paired(threshold), "set_a long, set_b long")
    if cut is not None and not cut.isEmpty():
        placed = postings.join(cut, "key").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
        pairs = pairs.unionByName(_pairs_across_chunks(chunk_groups(placed), threshold))
    return pairs.distinct()


def class_pairs(sig: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(set_a, set_b, similarity) of all different word sets that are at least ``threshold`` similar."""
    pairs = materialize(candidate_pairs(sig, threshold), "candidates")
    wanted = pairs.select(F.col("set_a").alias("set_id")).union(pairs.select(F.col("set_b").alias("set_id"))).distinct()
    heads = sig.where("id is not null").select("set_id", "id").join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("id").alias("id"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = source.join(heads, "id").groupBy("set_id").agg(F.min("text").alias("text"))
    checked = with_texts(pairs, texts, "set_a", "set_b", "set_id").select("set_a", "set_b", jaccard(F.col("text_a"), F.col("text_b")).alias("similarity"))
    return checked.where(F.col("similarity") >= F.lit(threshold - 1e-9))


def similar_pairs(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """All pairs (id_a < id_b) of different documents whose word sets are at least ``threshold`` similar.

    Documents with a null id or text, or with fewer than ``min_words`` words, have no pairs. Rows that repeat
    an id count once. Identical word sets are similarity 1. An empty table gives no rows. Other columns are
    ignored. The join is exact: nothing is capped or sampled.
    """
    sig = signed(docs, id_col, text_col, threshold, min_words)
    links = materialize(class_pairs(sig, docs, id_col, text_col, threshold).select("set_a", "set_b"), "links")
    members = members_of(sig)
    across = (
        links.join(members.select(F.col("id").alias("x"), F.col("set_id").alias("set_a")), "set_a")
        .join(members.select(F.col("id").alias("y"), F.col("set_id").alias("set_b")), "set_b")
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    copies = members.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id")
    inside = members.join(copies, "set_id")
    within = inside.select("set_id", F.col("id").alias("id_a")).join(inside.select("set_id", F.col("id").alias("id_b")), "set_id").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).distinct()


def link_counts(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """One row per document of at least ``min_words`` words: (id, class_id, links).

    ``class_id`` is the smallest id with the same word set and ``links`` the number of other documents that
    are at least ``threshold`` similar. Groups of copies are counted, never expanded into pairs.
    """
    sig = signed(docs, id_col, text_col, threshold, min_words)
    links = materialize(class_pairs(sig, docs, id_col, text_col, threshold).select("set_a", "set_b"), "links")
    members = members_of(sig)
    classes = members.groupBy("set_id").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = links.union(links.select("set_b", "set_a")).toDF("set_id", "other")
    far = both.join(classes.select(F.col("set_id").alias("other"), "copies"), "other").groupBy("set_id").agg(F.sum("copies").alias("far"))
    per_class = classes.join(far, "set_id", "left").select("set_id", "class_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("links"))
    return members.join(per_class, "set_id").select("id", "class_id", "links")
