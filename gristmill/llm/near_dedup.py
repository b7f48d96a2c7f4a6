"""MinHash near-deduplication with SuperMinHash signatures.

A document's set is its distinct word shingles.  Each shingle deals the ranks 0, 1, 2, ... to
the signature's slots in an order of its own, with a fraction added; a slot keeps the least
value.  Slots that hold less than a rank need no shingle's further ranks, so most documents
stop after a few.  Documents with equal sets are one class from here on, named by a number of its own.

Signatures are cut into bands, as many as leave a pair at the threshold a chance of at most
``MISS`` to share none.  Classes that share a band are compared: first each with the band's
least member (its lead), then, in bands whose members aren't all connected yet, each with a
member chosen by a hash, and at last all that are in different components still.  Pairs are
sieved by set sizes and 128-bit sketches of their signatures; what is left is confirmed on the
full sets.  For that last step bands of up to ``SMALL`` members give pairs.  The members of
larger ones come together under their leads, in blocks of bounded size, and an inverted index
over their shingles counts what each shares with the others; only pairs that reach the
threshold leave the task.  Links make components by alternating large and small stars (a distributed
union-find), and so do the texts of one doc_id; each component is named after its least doc_id, which
is the document to keep.

Bands never emit the pairs of connected members, whatever their size; nothing is capped.

Rows without words have an empty set, link with nothing and are kept.  Rows with a null doc_id are kept (component_id null).  Rows that repeat a doc_id are one
document: it is linked with what any of its texts is linked with.  doc_id is of an integer type.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark, _text

WORDS, PERCENT = 5, 80
#: Chance that a pair at the threshold shares no band.
MISS = 1e-7
#: Members of a band that are paired by a join, and shingles of a block of a larger one.
SMALL, BLOCK = 32, 2_000_000
#: Slots of a signature at most, and bits of its sketch.
SLOTS, BITS = 160, 128


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that the slots allow."""
    t = percent / 100
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - t**rows)) if t < 1 else 1
        if rows * bands <= SLOTS:
            return bands, rows
    return SLOTS, 1


def sketch_floor(percent: int) -> int:
    """Bits of two sketches that agree at least, six standard deviations below what the threshold leads to expect."""
    p = (1 + percent / 100) / 2
    return math.floor(BITS * p - 6 * math.sqrt(BITS * p * (1 - p)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of k words; of fewer words, of all of them as one."""
    if not len(words):
        return words
    return np.unique(_text.gram_hash(words, min(k, len(words))))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """The signatures of sets of 64-bit hashes, a row each; empty sets have infinite slots.

    All elements deal rank j in one step; the place of rank j comes from swaps in a row of
    slots, traced back through the element's earlier draws.
    """
    h = np.full((len(sets), slots), np.inf)
    size = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(size)
    if not len(live):
        return h
    element = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, size[live])
    flat = h.reshape(-1)
    draws: list[np.ndarray] = []
    for j in range(slots):
        u = _text.mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (u >> np.uint64(12)).astype(np.float64) * 2.0**-52 + j
        draw = (j + (_text.mix(u ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slots - j))).astype(np.int16)
        place = draw.copy()
        for i in range(j - 1, -1, -1):
            place[draws[i] == place] = i
        draws.append(draw)
        np.minimum.at(flat, owner * slots + place, value)
        # a set is done when every slot holds less than the next rank
        going = h[live].max(1) >= j + 1
        if not going.any():
            break
        if not going.all():
            done = np.zeros(len(sets), bool)
            done[live[~going]] = True
            keep = ~done[owner]
            element, owner, draws = element[keep], owner[keep], [d[keep] for d in draws]
            live = live[going]
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = _text.mix(h.view(np.uint64))[:, : bands * rows].reshape(len(h), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), (len(h), bands)).copy()
    for j in range(rows):
        key = _text.mix(key + x[:, :, j])
    return key


def sketches(h: np.ndarray) -> np.ndarray:
    """One bit of each of the first slots (taken again from the first if there are fewer), as two numbers."""
    x = _text.mix(h.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    x = x[:, np.arange(BITS) % x.shape[1]] >> np.uint64(63)
    return np.ascontiguousarray(np.packbits(x.astype(np.uint8), axis=1)).view(np.int64).reshape(len(h), BITS // 64)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    w = _text.split_words(texts, _text.SPACED)
    return [shingles(w.hash[a:b], k) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = s.sum(dtype=np.uint64), _text.mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, size and identity (a, b) of the set, sketch (s0, s1) and band keys of each row."""
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text.slices(batches, limit=1 << 20):
            sets = _sets(texts, words)
            h = super_minhash(sets, bands * rows)
            keys, bits = band_keys(h, bands, rows), sketches(h)
            names = [_identity(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield _spark.record(batch, ("doc_id",), n=np.array([len(s) for s in sets], np.int64), a=[a for a, _ in names], b=[b for _, b in names], s0=np.ascontiguousarray(bits[:, 0]), s1=np.ascontiguousarray(bits[:, 1]), bands=lists)

    return _spark.map_arrow(documents, run, "n long, a long, b long, s0 long, s1 long, bands array<long>")


def _full_sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and the full set of the classes in ``wanted`` (id, doc, a, b), from the text of their least doc_id that has this set."""
    docs = documents.select("doc_id", "text").join(wanted.select(F.col("doc").alias("doc_id"), "a", "b", "id"), "doc_id").select("text", "a", "b", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat a text give its set once
        for batch, texts in _text.slices(batches):
            sets = _sets(texts, words)
            own = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))))
            rows = []
            for i, (s, (a, b, id_)) in enumerate(zip(sets, own)):
                if id_ not in seen and len(s) and _identity(s) == (a, b):
                    seen.add(id_)
                    rows.append(i)
            at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])]).astype(np.int32)
            flat = np.concatenate([sets[i] for i in rows]) if rows else np.empty(0, np.uint64)
            ids = batch.column(3).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items array<long>")


def components(links: DataFrame) -> DataFrame:
    """id and root (the least id of its component) of each id in links (x, y)."""
    e = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    e = _spark.cut(e)
    before = None
    while True:
        # large star: each node's larger neighbours go to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours go to the least of these
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = _spark.cut(small.where("u <> v").distinct())
        _spark.release(e.sparkSession)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _close(x: str, y: str, percent: int) -> Column:
    """What no pair at the threshold lacks: sizes near enough, and sketches with enough equal bits."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = F.bit_count(c(x, "s0").bitwiseXOR(c(y, "s0"))) + F.bit_count(c(x, "s1").bitwiseXOR(c(y, "s1")))
    return (F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent) & (apart <= BITS - sketch_floor(percent))


def classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set that isn't empty: id (a number of its own), doc (its least doc_id), n, a, b, s0, s1 and bands."""
    one = signed.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").cast("long").alias("doc"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "bands")])
    # a column that may not be null would make the optimizer fail on the unions of links (a key is not found when it rewrites their constraints)
    return _spark.cut(one.withColumn("id", F.nullif(F.monotonically_increasing_id(), F.lit(-1))))


def same_document(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (x, y) between the classes of each doc_id that has several."""
    held = signed.where("n > 0 and doc_id is not null").select("doc_id", "a", "b").distinct()
    several = held.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    held = held.join(several, "doc_id", "left_semi").join(nodes.select("a", "b", "id"), ["a", "b"]).select("doc_id", "id")
    least = held.groupBy("doc_id").agg(F.min("id").alias("x"))
    return held.join(least, "doc_id").where("x <> id").select("x", F.col("id").alias("y"))


def link(documents: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Confirmed links (x, y) that connect all linked classes; none if no two share a band."""
    facts = nodes.select("id", "doc", "n", "a", "b", "s0", "s1")
    rows = nodes.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lead")).where("c > 1")
    members = _spark.cut(rows.join(shared, "key"))
    if members.isEmpty():
        return None
    wanted = facts.join(members.select("id").distinct(), "id", "left_semi")
    sets = _spark.cut(_full_sets(documents, wanted, words))
    facts = _spark.cut(wanted.drop("doc", "a", "b"))
    _spark.release(facts.sparkSession)
    done: DataFrame | None = None
    links: DataFrame | None = None

    def confirm(pairs: DataFrame) -> bool:
        """Adds those of the pairs (x < y) that are links; whether there were any new ones."""
        nonlocal done, links
        new = pairs if done is None else pairs.join(done, ["x", "y"], "left_anti")
        new = _spark.cut(new)
        if new.isEmpty():
            return False
        found = new.join(sets.select(F.col("id").alias("x"), F.col("items").alias("p")), "x").join(sets.select(F.col("id").alias("y"), F.col("items").alias("q")), "y")
        both = F.size(F.array_intersect("p", "q"))
        found = _spark.cut(found.where(both * 100 >= (F.size("p") + F.size("q") - both) * percent).select("x", "y"))
        done = new if done is None else done.unionByName(new)
        links = found if links is None else links.unionByName(found)
        _spark.release(links.sparkSession)
        return True

    def sieved(pairs: DataFrame) -> DataFrame:
        """The distinct pairs of ids (p, q) that may be linked, as x < y."""
        pairs = pairs.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).where("x < y").distinct()
        near = pairs.join(facts.select(F.col("id").alias("x"), F.struct("n", "s0", "s1").alias("fx")), "x").join(facts.select(F.col("id").alias("y"), F.struct("n", "s0", "s1").alias("fy")), "y")
        return near.where(_close("fx", "fy", percent)).select("x", "y")

    def open_members() -> DataFrame:
        """Members with their roots, of bands that are in more than one component."""
        now = members.select("key", "id", "lead", "c")
        now = now.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id")) if links is not None else now.withColumn("root", F.col("id"))
        several = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return _spark.cut(now.join(several, "key", "left_semi"))

    confirm(sieved(members.select(F.col("lead").alias("p"), F.col("id").alias("q"))))
    now = open_members()
    pick = F.xxhash64("key", "id")
    others = now.groupBy("key").agg(F.min_by(F.struct("id", "root"), pick).alias("other"))
    if confirm(sieved(now.join(others, "key").where("other.root <> root").select(F.col("other.id").alias("p"), F.col("id").alias("q")))):
        now = open_members()
    # all that is left, in small bands: members of different components
    few = now.where(F.col("c") <= SMALL).join(facts, "id").select("key", F.struct("id", "root", "n", "s0", "s1").alias("p"))
    pairs = few.join(few.withColumnRenamed("p", "q"), "key").where((F.col("p.id") < F.col("q.id")) & (F.col("p.root") != F.col("q.root")) & _close("p", "q", percent))
    confirm(pairs.select(F.col("p.id").alias("x"), F.col("q.id").alias("y")).distinct())
    # and in large ones: members outside their lead's main component with all others, in blocks
    many = _spark.cut(now.where(F.col("c") > SMALL).select("lead", "id", "root").distinct().join(facts.select("id", "n"), "id"))
    if not many.isEmpty():
        roots = many.groupBy("lead", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        leads = roots.groupBy("lead").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        rows = many.join(leads, "lead").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.join(sets.select("id", F.transform("items", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("items")), "id")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ask = rows.where("root <> main").withColumn("j", every).select("lead", F.col("own").alias("i"), "j", F.lit(0).alias("side"), "id", "root", "n", "items")
        answer = rows.withColumn("i", every).select("lead", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "id", "root", "n", "items")
        dealt = ask.unionByName(answer).repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "side", "id")
        confirm(dealt.mapInArrow(lambda batches: _compare(batches, percent), "x long, y long").distinct())
    return links


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that may reach the threshold, in each block of asking (side 0) and answering rows.

    Shingles are folded to 31 bits, which can only add to what two sets share: no pair is lost,
    and those that are left are confirmed on the full sets.
    """
    held: list[tuple] = []
    key = None

    def judge() -> pa.RecordBatch:
        ask, answer = [r for r in held if r[0] == 0], [r for r in held if r[0] == 1]
        out_x, out_y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if ask and answer:
            size = np.array([len(r[4]) for r in answer])
            items = np.concatenate([r[4] for r in answer])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], np.repeat(np.arange(len(answer)), size)[order]
            ids, roots, n = (np.array([r[k] for r in answer], np.int64) for k in (1, 2, 3))
            for _, i, root, m, mine in ask:
                lo, hi = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
                width = hi - lo
                total = int(width.sum())
                if not total:
                    continue
                at = np.arange(total) + np.repeat(lo - (np.cumsum(width) - width), width)
                shared = np.minimum(np.bincount(owner[at], minlength=len(answer)), np.minimum(n, m))
                ok = (shared * 100 >= (n + m - shared) * percent) & (roots != root) & (ids != i)
                out_x.append(np.minimum(ids[ok], i))
                out_y.append(np.maximum(ids[ok], i))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_x)), pa.array(np.concatenate(out_y))], names=["x", "y"])

    for batch in batches:
        get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        flat = {c: get[c].to_pylist() for c in ("lead", "i", "j", "side", "id", "root", "n")}
        for k in range(batch.num_rows):
            now = (flat["lead"][k], flat["i"][k], flat["j"][k])
            if now != key:
                if held:
                    yield judge()
                key = now
            # copied, so that the batch can go
            held.append((flat["side"][k], flat["id"][k], flat["root"][k], flat["n"][k], np.array(get["items"][k].values, np.int32)))
    if held:
        yield judge()


def group(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; links have 100 * intersection >= percent * union."""
    kind = documents.schema["doc_id"].dataType
    signed = _spark.cut(signatures(documents, words, percent))
    nodes = classes(signed)
    links = link(documents, nodes, words, percent)
    same = _spark.cut(same_document(signed, nodes))
    if not same.isEmpty():
        links = same if links is None else links.unionByName(same)
    named = nodes.select("a", "b", "doc", "id")
    if links is None:
        named = named.withColumn("root", F.col("id"))
    else:
        named = named.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(F.min("doc").alias("least")), "root").select("a", "b", "least")
    out = signed.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", F.col("doc_id"))).cast(kind)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns; of rows that repeat a doc_id the one whose text sorts first.

    Rows with a null doc_id all stay.
    """
    gone = group(documents, words, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    named = documents.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    first = named.withColumn("gm_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("gm_nth = 1").drop("gm_nth")
    return first.select(*documents.columns).unionByName(documents.where("doc_id is null"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END)) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.doc_id AS x, q.doc_id AS y FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id
  JOIN n a ON a.doc_id = p.doc_id JOIN n b ON b.doc_id = q.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY p.doc_id, q.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS id, doc_id AS reached FROM documents
  UNION
  SELECT r.id, e.y FROM r JOIN e ON e.x = r.reached
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(reached) AS component_id FROM r GROUP BY id) c USING (doc_id)
"""
