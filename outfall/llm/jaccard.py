"""N-gram Jaccard join by a token-group matrix (operator 6).

Documents are sets of word shingles; equal sets are one class. Two sets can only reach the threshold if they share tokens among their
first ones in one global order (frequent tokens last). Classes that share such tokens are put into groups; the matrix has, for each
token, the groups that hold it, and bounds what a class and a group have in common; tokens of the same groups are one row of it. A class is compared with its own group and the larger ones its first tokens lead to (of two groups the smaller asks): first with
each group's pivot, and only where that leaves a member of another component, the group is opened, block by block, if the overlap with the union of the
block's tokens allows a link at all. Links inside a component are not needed and not listed; none between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfall.llm.common import components, erase, pieces, row_key, stored
from outfall.llm.words import joined, mix, shingles, split_words

SIZE = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Percent of a set by which its first tokens are more than are needed to share one: similar sets share as many of them (see ``needed``).
LEAD = 15
#: Tokens that are sorted behind all others because they are frequent, at most. The order is free; results don't depend on it.
FREQUENT = 200_000
#: Documents of one piece of text from which a token is reported as frequent.
OFTEN = 6
#: Stands for the number of sets of a frequent token where that is not known yet.
MANY = 1 << 30
#: Entries in a bucket of tokens, about.
BUCKET = 400_000
#: Members of a group in one block.
BLOCK = 64
#: Classes that ask a group in one part, about.
PART = 256
#: Bits of the table that tells which rows are surely not asked for, at most.
BITS = 1 << 27
_PIECE = 4 << 20


def token_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, flat with bounds, and the signature of each set."""
    data, starts = joined(column)
    flat, bound = shingles(split_words(data, starts, lower=True), SIZE)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(1)), dtype=np.uint64)))
    return flat, bound, mix(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(np.uint64)).view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its signature and set size (kind 0), and tokens that many documents of a piece hold (kind 1)."""
    for batch in pieces(batches, "text", _PIECE):
        flat, bound, sig = token_sets(batch.column("text"))
        n = np.diff(bound)
        token, count = np.unique(flat, return_counts=True)
        token, count = token[count >= OFTEN].view(np.int64), count[count >= OFTEN]
        kind = np.repeat([0, 1], [len(n), len(token)]).astype(np.int32)
        ids, rows = (pa.concat_arrays([batch.column(c).cast(pa.int64()), pa.nulls(len(token), pa.int64())]) for c in ("doc_id", "rk"))
        key = pa.array(np.concatenate((sig, token)), mask=np.concatenate((n == 0, np.zeros(len(token), bool))))
        yield pa.RecordBatch.from_arrays([pa.array(kind), ids, rows, key, pa.array(np.concatenate((n, count)).astype(np.int64))], names=["kind", "doc_id", "rk", "key", "n"])


def first_count(n: np.ndarray) -> np.ndarray:
    """How many first tokens a set emits: all but PERCENT of them, and the lead. Two sets that share PERCENT of the larger share at least the smaller lead."""
    return np.minimum(n, n + (-n * PERCENT // 100) + np.maximum(1, n * LEAD // 100))


def needed(n: str) -> str:
    """SQL: first tokens that a set of size ``n`` shares with any set similar to it, at least: the lead of the smallest such set."""
    return f"greatest(1, ((({n} * {PERCENT} + 99) div 100) * {LEAD}) div 100)"


def _first_tokens(frequent: tuple[np.ndarray, np.ndarray], buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first tokens of each set, packed by bucket of the token; frequent ones in buckets below zero, by set."""
    known, rank = frequent
    for batch in pieces(batches, "text", _PIECE):
        flat, bound, sig = token_sets(batch.column("text"))
        _, once = np.unique(sig, return_index=True)  # of equal sets one
        n = np.diff(bound)[once]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bound[:-1][once], n)
        flat, sig, doc = flat[at], sig[once], np.repeat(np.arange(len(n)), n)
        late = np.zeros(len(flat), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            late = np.where(known[at] == flat, rank[at], 0)
        order = np.lexsort((flat, late, doc))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        chosen = order[place < np.repeat(first_count(n), n)]
        token, owner, often = flat[chosen], sig[doc[chosen]].view(np.uint64), late[chosen] > 0
        spread = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        bucket = np.where(often, -1 - spread(owner), spread(token))
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-(1 << 40)))
        pair = np.column_stack((token, owner))[order]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut].astype(np.int32)), pa.array([np.ascontiguousarray(x).tobytes() for x in np.split(pair, cut[1:])] if len(cut) else [], pa.binary())], names=["bucket", "packed"])


def _shared(frame):
    """(token, sig, df) of the tokens of a bucket that two sets or more hold, and of all frequent ones, whose df is that of the bucket."""
    import pandas as pd

    pair = np.frombuffer(b"".join(frame["packed"]), np.uint64).reshape(-1, 2)
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
    pair = pair[new]
    begin = np.flatnonzero(np.concatenate(([True], pair[1:, 0] != pair[:-1, 0])))
    df = np.repeat(np.diff(np.append(begin, len(pair))), np.diff(np.append(begin, len(pair))))
    often = bool(frame["bucket"].iloc[0] < 0)
    many = (df > 1) | often
    return pd.DataFrame({"token": pair[many, 0].view(np.int64), "sig": pair[many, 1].view(np.int64), "df": np.full(int(many.sum()), MANY) if often else df[many]})


def shared_across(kept: DataFrame) -> DataFrame:
    """The rows (token, sig, g, n) whose token more than one group holds."""
    groups = kept.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    return kept.join(groups, "token", "left_semi")


def able(across: DataFrame, tokens: str = "count(1)") -> DataFrame:
    """Of the rows of ``shared_across`` those of sets with enough tokens in more than one group to need another group; fewer cannot reach ``needed`` with any."""
    enough = across.groupBy("sig").agg(F.expr(tokens).alias("c"), F.min("n").alias("n")).where(f"c >= {needed('n')}").select("sig")
    return across.join(enough, "sig", "left_semi")


def grouped(shared: DataFrame, least: DataFrame) -> DataFrame:
    """The rows (token, sig) of sets that hold enough shared first tokens, with n, held, doc_id, rk and the set's group g.

    A set joins the group of the token that most sets have among their first ones, so that copies of one text gather in few groups. Frequent tokens are
    counted here: the last ones among a set's first tokens differ from copy to copy, and so would a choice by order.
    A set that shares fewer first tokens than a similar one would has none.
    """
    own = Window.partitionBy("sig")
    counted = shared.where(F.col("df") == MANY).groupBy("token").agg(F.count(F.lit(1)).alias("sets"))  # at most FREQUENT tokens
    shared = shared.join(F.broadcast(counted), "token", "left").withColumn("df", F.coalesce("sets", "df")).where("df > 1")
    told = shared.select("token", "sig", F.max(F.struct("df", "token")).over(own).getField("token").alias("g"), F.count(F.lit(1)).over(own).alias("held"))
    return told.join(least, "sig").where(f"held >= {needed('n')}")


def by_mark(across: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens that the same groups hold are one mark (k groups, x, y): (sig, g, n, mark, w tokens), and (mark, other group).

    Sets of groups with equal marks would only add candidates.
    """
    matrix = stored(across.select("token", F.col("g").alias("other")).distinct(), "matrix")
    marks = stored(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.expr("bit_xor(xxhash64(other)) AS x"), F.expr("bit_xor(xxhash64(1, other)) AS y")), "marks")
    held = stored(across.join(marks, "token").groupBy("sig", "k", "x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("g").alias("g"), F.min("n").alias("n")), "held")
    one = marks.groupBy("k", "x", "y").agg(F.min("token").alias("token"))
    lead = stored(matrix.join(one, "token").select("k", "x", "y", "other"), "lead")
    erase(matrix, marks)
    return held, lead


def extents(named: DataFrame) -> DataFrame:
    """(g, room, low, high): how many sets a group has, and the sizes of its smallest and largest set."""
    return named.groupBy("g").agg(F.count(F.lit(1)).alias("room"), F.min("n").alias("low"), F.max("n").alias("high"))


def candidates(held: DataFrame, lead: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(sig, g): the other groups that may hold as many of a set's tokens as ``needed``, and few more.

    With ``sizes`` (of ``extents``) only those that have sets of a similar size and are larger than the set's own group, or as large and of a higher
    number: two similar sets share what is needed of either, so the one in the smaller group finds the other, and the many sets of a large group ask few.

    Of a set's marks those of most groups do not ask, as long as all that do not ask have fewer tokens than are needed; a group that
    holds enough is then met by another mark, and all that did not ask count for every group.
    """
    rank = Window.partitionBy("sig").orderBy(F.desc("k"), "x", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asks = held.withColumn("upto", F.sum("w").over(rank)).withColumn("silent", F.max(F.expr(f"CASE WHEN upto < {needed('n')} THEN upto ELSE 0 END")).over(Window.partitionBy("sig")))
    asks, other = asks.where(f"upto >= {needed('n')}"), "g <> other"
    if sizes is not None:
        asks = asks.join(sizes.select("g", F.col("room").alias("own")), "g")
        lead = lead.join(sizes.withColumnRenamed("g", "other"), "other")
        other = f"(room > own OR room = own AND other > g) AND 100 * high >= {PERCENT} * n AND 100 * n >= {PERCENT} * low"
    met = asks.join(lead, ["k", "x", "y"]).where(other)
    enough = met.groupBy("sig", "other").agg((F.sum("w") + F.min("silent")).alias("c"), F.min("n").alias("n")).where(f"c >= {needed('n')}")
    return enough.select("sig", F.col("other").alias("g"))


def maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose rk is one of ``keys``, and some others: a bit table of bounded size drops most others before a shuffle."""
    size = 1 << 10
    while size < min(BITS, 16 * keys.count()):
        size *= 2
    words = keys.select((F.col("rk").bitwiseAND(size - 1)).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT))) AS bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(bits)  # at most BITS / 8 bytes

    def known(rk: pa.Array) -> pa.Array:
        at = rk.to_numpy().view(np.uint64) & np.uint64(size - 1)
        return pa.array((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

    return rows.where(F.arrow_udf(known, "boolean")("rk"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", _PIECE):
        flat, bound, sig = token_sets(batch.column("text"))
        wanted = batch.column("sig").to_numpy()
        at = np.flatnonzero(sig == wanted)
        yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array([flat[bound[i]:bound[i + 1]].tobytes() for i in at], pa.binary())], names=["sig", "tokens"])


def reaches(overlap: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if reaches(min(len(x), len(y)), len(x), len(y)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(reaches(int((y[at] == x).sum()), len(x), len(y))))
            else:
                keep.append(False)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")


def _opened(frame):
    """Links between the queries and the members of one block of a group that lie in different components."""
    import pandas as pd

    member = frame["member"].to_numpy()
    sig, comp = frame["sig"].to_numpy(), frame["comp"].to_numpy()
    tokens = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
    size = np.array([len(t) for t in tokens])
    inside = np.flatnonzero(member)
    flat = np.concatenate([tokens[i] for i in inside]) if len(inside) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(inside)), size[inside])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, begin, held = np.unique(flat, return_index=True, return_counts=True)
    a, b = [], []
    for q in np.flatnonzero(~member):
        if not len(union):
            break
        at = np.minimum(np.searchsorted(union, tokens[q]), len(union) - 1)
        at = at[union[at] == tokens[q]]
        if 100 * len(at) < PERCENT * size[q]:  # the bound: no member can reach the threshold
            continue
        n = held[at]
        overlap = np.bincount(owner[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)], minlength=len(inside))
        for i in inside[reaches(overlap, size[q], size[inside]) & (comp[inside] != comp[q])]:
            a.append(sig[q])
            b.append(sig[i])
    found = pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "x": [comp[0]] * 0 or np.zeros(len(a), np.int64)})
    if len(found):  # one link from a query to a component is enough
        of = dict(zip(sig.tolist(), comp.tolist(), strict=True))
        found["x"] = [of[s] for s in found["b"]]
    return found.drop_duplicates(["a", "x"])[["a", "b"]]


def openings(asking: DataFrame, placed: DataFrame, spread: DataFrame) -> DataFrame:
    """(sig, g, comp, block, part, member): which members and which asking classes of a group meet in one frame, about BLOCK and PART of them.

    asking: sig, g, comp, blocks. placed: the members' sig, g, comp. spread: g, blocks. Each asking class meets every block of its group once.
    """
    parts = stored(asking.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    inside = placed.join(spread.select("g", "blocks"), "g").join(parts, "g").select(
        "sig", "g", "comp", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"))
    queries = asking.join(parts, "g").select(
        "sig", "g", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("member"))
    return inside.union(queries)


def _labels(edges: DataFrame, members: DataFrame) -> DataFrame:
    return stored(members.select("sig").join(components(edges).withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("label", "sig").alias("comp")), "labels")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, rk, n_shingles, comp, component_id of each row of ``docs`` (doc_id, text): the smallest doc_id reachable by links.

    rk is the row's content key; comp is the component's own number, null for a row without shingles.

    A null or empty text and one without words have no shingles and link with nothing. Equal sets are linked, so repeated rows are. A null doc_id is never
    the smallest unless no other is reachable. A text with fewer than five words is one shingle. Other columns are left out. No documents: no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", row_key(docs).alias("rk"))
    survey = stored(texts.mapInArrow(_survey, "kind int, doc_id long, rk long, key long, n long"), "survey")
    found = survey.where("kind = 0").select("doc_id", "rk", F.col("key").alias("sig"), "n")
    often = survey.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key = often["key"].to_numpy().view(np.uint64)
    by = np.argsort(key)
    frequent = spark.sparkContext.broadcast((key[by], often["n"].to_numpy()[by]))  # at most FREQUENT tokens
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(64, total * (100 - PERCENT + LEAD) // 100 // BUCKET)

    packed = texts.mapInArrow(lambda batches: _first_tokens(frequent.value, buckets, batches), "bucket int, packed binary")
    shared = stored(packed.groupBy("bucket").applyInPandas(_shared, "token long, sig long, df int"), "shared")

    least = stored(found.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"), F.min("n").alias("n")), "classes")
    kept = stored(grouped(shared, least), "kept")
    erase(shared)
    named = stored(kept.select("sig", "g", "held", "doc_id", "rk", "n").distinct(), "named")
    sizes = stored(extents(named), "sizes")
    # Its own group leads a class to itself; larger groups do by tokens that more than one group holds.
    across = stored(shared_across(kept.select("token", "sig", "g", "n")), "across")
    erase(kept)
    held, lead = by_mark(across)
    others = candidates(able(held, "sum(w)"), lead, sizes)
    led = stored(named.select("sig", "g", F.lit(True).alias("own")).union(others.select("sig", "g", F.lit(False))), "led")
    erase(across, held, lead, sizes)
    wanted = named.select("sig", "rk")
    rows = maybe(texts.select("rk", "text"), wanted).join(wanted, "rk").select("rk", "sig", "text").distinct()  # repeated rows once
    sets = stored(rows.select("text", "sig").mapInArrow(_sets, "sig long, tokens binary"), "sets")

    # The pivot of a group is the member whose first tokens are shared the most: what others are copies of.
    pivots = stored(named.groupBy("g").agg(F.max(F.struct((F.col("held") / F.col("n")).alias("share"), "sig")).alias("p")).select("g", F.col("p.sig").alias("pivot")), "pivots")
    links = stored(verified(named.join(pivots, "g").where("sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")), sets), "links")
    labels = _labels(links, named)
    apart = led.where("NOT own").join(pivots, "g").join(labels, "sig").join(labels.select(F.col("sig").alias("pivot"), F.col("comp").alias("other")), "pivot").where("comp <> other")
    links = links.union(stored(verified(apart.select(F.col("sig").alias("a"), F.col("pivot").alias("b")).distinct(), sets), "links"))
    erase(labels)
    labels = _labels(links, named)

    # Groups are opened for a class if a member other than the pivot lies in another component; its own group only for one that lies outside
    # the pivot's component itself, which of two members that may still be linked at least one does.
    placed = named.select("sig", "g").join(labels, "sig").join(pivots, "g").where("sig <> pivot").select("sig", "g", "comp")
    spread = stored(placed.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "spread")
    hubs = stored(pivots.join(labels.select(F.col("sig").alias("pivot"), F.col("comp").alias("hub")), "pivot").select("g", "hub").join(spread, "g"), "hubs")
    asking = led.join(labels, "sig").join(hubs, "g").where("(low <> comp OR high <> comp) AND NOT (own AND hub = comp)")
    asking = stored(asking.select("sig", "g", "comp", "blocks"), "asking")
    tasks = openings(asking, placed, spread).join(sets, "sig")
    opened = stored(tasks.groupBy("g", "block", "part").applyInPandas(_opened, "a long, b long"), "opened")
    erase(sets, asking, hubs, spread, labels, led, pivots)
    labels = components(links.union(opened))

    whole = stored(least.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("label", "sig").alias("comp")), "whole")
    lowest = stored(whole.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "lowest")
    facts = stored(whole.join(lowest, "comp").select("sig", "comp", "component_id"), "facts")
    return found.join(facts, "sig", "left").select("doc_id", "rk", F.col("n").alias("n_shingles"), "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last), then content key; rows without shingles stay.

    Of fully repeated rows (equal doc_id and text) that are chosen, one stays.
    """
    rows = stored(similar_components(docs), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    best = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(first).alias("b")).select("b.doc_id", "b.rk")
    kept = best.union(rows.where("comp IS NULL").select("doc_id", "rk")).distinct().select(F.col("doc_id").alias("__doc"), F.col("rk").alias("__key"))
    numbered = docs.withColumn("__rk", row_key(docs)).join(kept, F.expr("__rk = __key AND doc_id <=> __doc"))
    return numbered.dropDuplicates(["__rk", "__doc"]).select(*docs.columns)
