"""Near duplicates by MinHash with tensored tables, verified on whole shingle sets.

Two small collections of ``side`` half keys each (a half key is ``rows`` minhashes) give
``side * side`` tables: table (i, j) is keyed by half key i of the first collection
together with half key j of the second. So 2 * side * rows minhashes serve
side ** 2 tables of 2 * rows minhashes each. A pair is missed only if all half keys of one
collection differ: at most 2 * (1 - s ** rows) ** side of the pairs of similarity s, which is
0.06 % at 0.8 with the defaults and nothing to speak of above 0.9.

Exact copies of a set are one class from the start. In a table's bucket every
member is compared with the most central one, the leader. Where that leaves different
components among the members of a leader, those outside the largest component
are compared with all of them, block by block, without forming pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, id_and_text, in_batches, sole

c = F.col

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_word_hashes: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _hash(word: bytes) -> int:
    if len(_word_hashes) > 300_000:
        _word_hashes.clear()
    h = _word_hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of the ``n``-word shingles; fewer words are one shingle, no words none.

    Words are cut at blank, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    get = sole(_word_hashes).get
    h = np.array([get(w) or _hash(w) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        size = max(1, len(h) - n + 1)
        x = np.full(size, min(len(h), n), dtype=np.uint64)
        for i in range(min(len(h), n)):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + size])
    return np.unique(x)


def half_keys(shingles: np.ndarray, side: int, rows: int) -> np.ndarray:
    """2 * side half keys, each of ``rows`` minhashes."""
    k = 2 * side * rows
    with np.errstate(over="ignore"):
        odd = _mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        low = np.empty(k, dtype=np.uint64)
        for i in range(k):  # one function at a time: memory stays that of the set
            y = shingles * odd[i]
            low[i] = (y ^ (y >> np.uint64(29))).min() if i % 2 else (y + (y >> np.uint64(32))).min()
        out = np.zeros(2 * side, dtype=np.uint64)
        for i in range(rows):
            out = _mix(out * np.uint64(31) + low[i::rows])
    return out.view(np.int64)


def sketches(docs: DataFrame, n: int, side: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, halves): the set's size, 128-bit fingerprint and half keys."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()),
         T.StructField("f2", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType()))]
    )

    def made(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, n)
                if not len(s):
                    yield doc, 0, 0, 0, []
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                f1, f2 = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
                yield doc, len(s), f1, f2, half_keys(s, side, rows).tolist()

    return docs.mapInArrow(lambda it: in_batches(schema, made(it)), schema)


def unpacked(data: bytes) -> np.ndarray:
    """The shingles of a packed set, sorted."""
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.sort(wide.reshape(-1).view("<u8"))


def packed_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted``: the whole set, 6 bytes for each shingle.

    With 48 bits of a hash, two different shingles of two documents of 1,000 fall
    together once in 10^8 such pairs.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.BinaryType())])

    def sets(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield doc, shingle_set(text, n).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: in_batches(schema, sets(it), 256), schema)


def verified(sets: DataFrame, pairs: DataFrame, percent: int, most_in_turn: int = 2000) -> DataFrame:
    """(a, b, same, n_a, n_b, linked) for pairs (a, b), on the whole sets of both documents.

    A partition holds one set b and streams the members a after it. The
    members of a frequent b are dealt over several such turns.
    """
    id_type = sets.schema["doc_id"].dataType
    turns = pairs.groupBy("b").agg(F.ceil(F.count("*") / most_in_turn).cast("int").alias("turns"))
    wanted = (
        pairs.join(turns, "b")
        .select(c("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), "turns").cast("int").alias("turn"))
        .union(turns.select(c("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), c("turns") - 1)).alias("turn")))
    )
    dealt = (
        sets.join(wanted, "doc_id")
        .select("b", "turn", (c("b") != c("doc_id")).cast("int").alias("member"), c("doc_id").alias("a"), "shingles")
        .repartition("b", "turn").sortWithinPartitions("b", "turn", "member")
    )
    out = T.StructType(
        [T.StructField("a", id_type), T.StructField("b", id_type)]
        + [T.StructField(x, T.LongType()) for x in ("same", "n_a", "n_b")] + [T.StructField("linked", T.BooleanType())]
    )

    def compared(batches):
        held, turn = [], None
        for batch in batches:
            for b, k, member, a, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (b, k) != turn:
                    held, turn = [], (b, k)
                x = unpacked(data)
                if not member:
                    held.append(x)
                    continue
                rows = []
                for y in held:  # more than one only where rows share an id
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    same = int((y[at] == x).sum())
                    rows.append((a, b, same, len(x), len(y), 100 * same >= percent * (len(x) + len(y) - same)))
                yield max(rows, key=lambda r: r[2] / (r[3] + r[4] - r[2]))

    return dealt.mapInArrow(lambda it: in_batches(out, compared(it)), out).dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), for every node of an edge.

    Large-star and small-star steps in turn until nothing changes; each round is
    written to the shared folder. Rounds grow with the logarithm of the longest path.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(c("v").alias("u"), c("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        joined = near.join(low, "u")
        if large:
            out = joined.where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v"))
        else:
            out = joined.select(c("v").alias("u"), c("m").alias("v")).union(joined.select("u", c("m").alias("v")))
        return out.where(c("u") != c("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(e.agg(F.count("*"), F.sum(h)).first())

    now = cut_lineage(edges.where(c("u") != c("v")).select("u", "v").distinct(), "edges")
    before = None
    while (state := mark(now)) != before:
        before = state
        if not state[0]:
            break
        now = cut_lineage(star(star(now, True), False), "edges")
    return now.select(c("u").alias("node"), c("v").alias("component")).union(
        now.select(c("v").alias("node"), c("v").alias("component")).distinct()
    )


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, side: int = 8, rows: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``n``-word shingles; the component id is the smallest document id that links lead to, and
    that document is kept. Documents without words are linked with nothing. Rows
    that share an id are one node and all get its component; rows without an id
    are linked with nothing, have a null component and are kept. No document: no row.
    """
    narrow = id_and_text(docs, id_col, text_col)
    sketch = cut_lineage(sketches(narrow, n, side, rows), "sketches")
    texts = narrow.where(c("doc_id").isNotNull())
    named = sketch.where(c("doc_id").isNotNull() & (c("n_shingles") > 0))
    classes = named.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n_shingles", "halves")).alias("first"))
    first = cut_lineage(classes.select("f1", "f2", "first.*"), "classes")

    tables = f"transform(sequence(0, {side * side - 1}), t -> xxhash64(t, halves[t div {side}], halves[{side} + t % {side}]))"
    keyed = first.select("doc_id", c("n_shingles").alias("n"), F.explode(F.expr(tables)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    hits = cut_lineage(keyed.join(shared, "key"), "buckets")
    # the text that others were made from shares most buckets with most of them
    central = hits.groupBy("doc_id").agg(F.sum("members").alias("central"))
    hits = hits.drop("members").join(central, "doc_id")
    lead = hits.groupBy("key").agg(F.max_by("doc_id", F.struct("central", F.xxhash64("doc_id"))).alias("leader"))
    hits = cut_lineage(hits.join(lead, "key"), "led")

    sets = cut_lineage(packed_sets(texts, hits.select("doc_id").distinct(), n), "sets")
    stars = hits.where(c("doc_id") != c("leader")).select(c("doc_id").alias("a"), c("leader").alias("b")).distinct()
    stars = cut_lineage(stars, "star_pairs")
    links = cut_lineage(verified(sets, stars, percent).where("linked").select(c("a").alias("u"), c("b").alias("v")), "links")
    links = links.union(cut_lineage(remaining_links(stars, links, sets, percent), "more_links"))
    of = first.select("f1", "f2", c("doc_id").alias("class"))
    # rows that share an id but not a text tie their classes together
    mine = named.join(of, ["f1", "f2"]).groupBy("doc_id")
    tied = mine.agg(F.min("class").alias("v"), F.max("class").alias("high")).where("v != high").drop("high")
    ties = named.join(of, ["f1", "f2"]).join(tied, "doc_id").select(c("class").alias("u"), "v")
    whole = components(links.union(ties))
    out = sketch.join(of, ["f1", "f2"], "left")
    out = out.join(whole, out["class"] == whole["node"], "left")
    component = F.coalesce("component", "class", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.when(c("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(c("doc_id") == component, F.lit(True)).alias("kept"),
    )


def remaining_links(stars: DataFrame, links: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links (u, v) between members of a leader's group that its star left in different components.

    Two documents of one bucket are in the group of that bucket's leader. The
    members outside a group's largest component are dealt over blocks of about
    ``block``; each block is held as an index of its shingles, and all members of
    the group are streamed past it. No pairs are formed; of the links of a
    document with one component, one is returned for each block.
    """
    id_type = sets.schema["doc_id"].dataType
    part = components(links)
    group = stars.select(c("b").alias("leader"), c("a").alias("doc_id")).union(
        stars.select(c("b").alias("leader"), c("b").alias("doc_id")).distinct()
    )
    group = group.join(part, group["doc_id"] == part["node"], "left")
    group = cut_lineage(group.select("leader", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "groups")
    sizes = group.groupBy("leader", "comp").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("leader")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), (F.sum("n") - F.max("n")).alias("few"))
        .where("few > 0").withColumn("blocks", F.ceil(c("few") / block).cast("int"))
    )
    members = cut_lineage(group.join(mixed, "leader"), "mixed_groups")
    own = F.pmod(F.xxhash64("doc_id"), c("blocks")).cast("int")
    few = members.where(c("comp") != c("most")).select("leader", own.alias("block"), F.lit(0).alias("turn"), "doc_id", "comp")
    every = members.select("leader", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("block"), F.lit(1).alias("turn"), "doc_id", "comp")
    dealt = (
        sets.join(few.union(every), "doc_id").select("leader", "block", "turn", "doc_id", "comp", "shingles")
        .repartition("leader", "block").sortWithinPartitions("leader", "block", "turn")
    )
    out = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)])

    def linked(batches):
        now, held, index, told = None, [], None, set()
        for batch in batches:
            for leader, k, turn, doc, comp, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (leader, k) != now:
                    now, held, index, told = (leader, k), [], None, set()
                x = unpacked(data)
                if not turn:
                    held.append((doc, comp, x))
                    continue
                if not held:
                    continue
                if index is None:
                    index = _index([y for _, _, y in held])
                    size = np.array([len(y) for _, _, y in held])
                same = _overlaps(x, *index, len(held))
                for i in np.flatnonzero(100 * same >= percent * (size + len(x) - same)):
                    other, its, _ = held[i]
                    if its != comp and (other, comp) not in told:
                        told.add((other, comp))
                        yield doc, other

    return dealt.mapInArrow(lambda it: in_batches(out, linked(it)), out).distinct()


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, where each one's owners begin, owners)."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    distinct, begin = np.unique(every[order], return_index=True)
    return distinct, np.append(begin, len(every)), owner[order]


def _overlaps(x: np.ndarray, distinct: np.ndarray, begin: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many shingles of ``x`` each owner has."""
    at = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
    at = at[distinct[at] == x]
    size = begin[at + 1] - begin[at]
    place = np.arange(size.sum()) + np.repeat(begin[at] - (np.cumsum(size) - size), size)
    return np.bincount(owner[place], minlength=n)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were.

    Rows that share a kept id all stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **params)
    gone = found.where(~c("kept")).select(c("doc_id").alias(fresh(docs, "gone_id")[0])).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone[gone.columns[0]], "left_anti")
