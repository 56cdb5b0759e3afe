"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles becomes a signature of ``POSITIONS`` MinHash
values of 16 bits.  Signatures are cut into chunks; by the pigeonhole
principle two signatures that differ in fewer than ``2 * CHUNKS`` places have a
chunk with at most one difference, and every allowed chunk error is enumerated
by leaving out one position of the chunk in turn.  So all pairs within
``2 * CHUNKS - 1`` differing positions share a key.  At a similarity of exactly
0.75 a pair shares none with a probability of 5e-6, and of 1e-8 at 0.8.

Pairs that share a key are confirmed on full shingle sets.  Texts with equal
sets are one node from the start.  Nodes first meet a few leaders of their keys;
pairs that this has joined need no further look.  Of what is left, the pairs of
keys with few nodes are enumerated, at most ``SMALL_KEY`` a row.  In keys with
many nodes those drop out that have too many shingles of their own to be like
any other there; the rest are compared in place, block against block, first by
signatures, and of blocks with alike ones the full sets of just these nodes
follow.  No pairs are emitted there, only links.

Defined results: a null or blank text has no shingles, is linked with nothing
and is its own component; a text under five words is one shingle; a null
document id is passed on and joins the component of its text; a component
without any id has a null one, and one of its rows is kept; repeated rows belong
to one component, and all rows of its least id are kept; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cache, stage, use_cache
from .components import connected_components

SHINGLE = 5
CHUNKS, WIDTH = 16, 6
POSITIONS = CHUNKS * WIDTH
#: Pairs whose signatures agree in fewer positions are not confirmed: for a
#: similarity of 0.75 that has a probability of 2e-8.
LEAST_AGREE = 48
SHINGLES_AT_ONCE = 16_384
KNOWN_WORDS = 150_000
#: Leaders that a node is compared with first, of those whose signatures agree most.
LEADERS = 3
#: Nodes of a key whose pairs are enumerated; those of larger keys are compared in place.
SMALL_KEY = 48
#: Nodes and shingles of a block of a large key.
BLOCK_NODES, BLOCK_SHINGLES = 2_000, 1_000_000
#: The nodes that share a key are broadcast up to this size, and shuffled beyond it.
INVOLVED_BYTES, BROADCAST_BYTES = 300, 16 << 20

_random = np.random.Generator(np.random.PCG64(20240607))
_WORD_TIMES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_TIMES = _random.integers(1, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HASH_PLUS = _random.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_KEY_TIMES = _random.integers(1, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_PLUS = _random.integers(0, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
cache("shingles", _words.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and ASCII white
    space only, which is what the operator's words are defined by.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    if len(ids) < SHINGLE:
        return _mix((ids * _WORD_TIMES[: len(ids)]).sum(keepdims=True) + np.uint64(len(ids)))
    n = len(ids) - SHINGLE + 1
    total = ids[:n] * _WORD_TIMES[0]
    for j in range(1, SHINGLE):
        total += ids[j : j + n] * _WORD_TIMES[j]
    return np.unique(_mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (rows of ``POSITIONS`` 16-bit values) of non-empty sets."""
    out = np.empty((len(sets), POSITIONS), np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = first + 1
        total = sizes[first]
        while last < len(sets) and total + sizes[last] <= SHINGLES_AT_ONCE:
            total += sizes[last]
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[first:last]) - sizes[first:last]
        y = np.empty_like(x)
        for k in range(POSITIONS):
            np.multiply(x, _HASH_TIMES[k], out=y)
            np.add(y, _HASH_PLUS[k], out=y)
            out[first:last, k] = np.minimum.reduceat(y, starts)
        first = last
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The ``CHUNKS * WIDTH`` keys of each signature: a chunk without one position."""
    terms = signature.reshape(-1, CHUNKS, WIDTH).astype(np.uint64) * _KEY_TIMES
    keys = terms.sum(2, keepdims=True) - terms + _KEY_PLUS
    return _mix(keys).reshape(len(signature), -1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use_cache("shingles")
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        signature: list[bytes | None] = [None] * len(sets)
        key: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                signature[i] = row.tobytes()
                key[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(2),
                batch.column(3),
                batch.column(4),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(key, pa.binary()),
                pa.array(signature, pa.binary()),
            ],
            names=["doc_id", "pick", "row", "text_hash", "n_shingles", "set_key", "signature"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use_cache("shingles")
    step = 512
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            some = batch.slice(i, step)
            rows = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = chunk_keys(rows)
            nodes = np.repeat(some.column(0).to_numpy(), keys.shape[1])
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use_cache("shingles")
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        own = [k == xxhash.xxh3_128_digest(s) for k, s in zip(batch.column(2).to_pylist(), sets, strict=True)]
        out = pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "members"])
        yield out.filter(pa.array(own, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shingle of each node."""
    for batch in batches:
        for node, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = np.frombuffer(members, np.int64)
            for i in range(0, len(tokens), TOKENS_AT_ONCE):
                some = tokens[i : i + TOKENS_AT_ONCE]
                yield pa.record_batch([pa.array(np.full(len(some), node)), pa.array(some)], names=["node", "token"])


TOKENS_AT_ONCE = 100_000


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use_cache("shingles")
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, POSITIONS) for i in (2, 3))
            n = (x == y).sum(1)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(n)], names=["a", "b", "agree"])
            yield out.filter(pa.array(n >= LEAST_AGREE))


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hold.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))

    return confirm


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``a, b`` and ``column`` of either node."""
    left = of.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = of.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _member_sets(texts: DataFrame, involved: DataFrame) -> DataFrame:
    """``node, members``: the full shingle set of each node that shares a key."""
    if involved.count() * INVOLVED_BYTES <= BROADCAST_BYTES:
        involved = F.broadcast(involved)
    found = texts.join(involved, "pick").select("node", "text", "set_key")
    return stage(found.mapInArrow(_sets, "node long, members binary").dropDuplicates(["node"]), "members")


def _leaders(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: each node with the leaders of its keys (the least and greatest node of each) whose signatures agree most."""
    tries = shared.select("node", F.explode(F.array("hub", "last")).alias("leader")).filter("node <> leader").distinct()
    tries = tries.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    agreeing = _with_both(tries, nodes, "signature").mapInArrow(_agree, "a long, b long, agree long")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))
    return agreeing.withColumn("place", best).filter(F.col("place") <= LEADERS).select("a", "b")


def _open_keys(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """``key, node, part, m`` of the keys whose ``m`` nodes are not all of one part."""
    d = shared.select("key", "node").join(parts, "node")
    same = d.groupBy("key").agg(F.count("*").alias("m"), F.min("part").alias("p"), F.max("part").alias("q"))
    return stage(d.join(same.filter("p < q").select("key", "m"), "key"), "open")


def _unique_shingles(crowded: DataFrame, members: DataFrame) -> DataFrame:
    """``node, own``: how many shingles a node of ``crowded`` has that no other node there has."""
    tokens = members.join(crowded.select("node").distinct(), "node").mapInArrow(_tokens, "node long, token long")
    own = tokens.groupBy("token").agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1")
    return own.groupBy("node").agg(F.count("*").alias("own"))


def _blocks(crowded: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``key, i, j, block, node, part, n, common``: the nodes of large keys, in every pair of blocks that they belong to.

    ``common`` is the number of a node's shingles that others have too; with
    fewer than ``percent`` of its own number it is like no other and drops out.
    """
    d = crowded.join(nodes.select("node", "n"), "node").join(_unique_shingles(crowded, members), "node", "left")
    d = d.withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).filter(100 * F.col("common") >= percent * F.col("n"))
    d = stage(d.select("key", "node", "part", "n", "common"), "crowded")
    need = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    size = d.groupBy("key").agg(need.alias("blocks"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q")
    d = d.join(size.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return d.select("key", i.alias("i"), j.alias("j"), "block", "node", "part", "n", "common")


def alike(frame: pd.DataFrame, percent: int) -> np.ndarray:
    """Which nodes of a pair of blocks may be like one of another part, by signatures, sizes and common shingles."""
    s = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, POSITIONS)
    n, c, part, block = (frame[x].to_numpy() for x in ("n", "common", "part", "block"))
    across = frame["i"].iloc[0] != frame["j"].iloc[0]
    found = np.zeros(len(frame), bool)
    for a in range(len(frame) - 1):
        most = np.minimum(c[a + 1 :], c[a])
        may = (part[a + 1 :] != part[a]) & (100 * most >= percent * (n[a + 1 :] + n[a] - most))
        if across:
            may &= block[a + 1 :] != block[a]
        b = np.flatnonzero(may) + a + 1
        b = b[(s[b] == s[a]).sum(1) >= LEAST_AGREE]
        if len(b):
            found[a] = found[b] = True
    return found


def _within_blocks(blocks: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of large keys: enough of them to join all that their pairs join."""
    kept = "key long, i int, j int, block int, node long, part long"

    def survivors(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        return frame.loc[alike(frame, percent), ["key", "i", "j", "block", "node", "part"]]

    signed = blocks.join(nodes.select("node", "signature"), "node")
    left = stage(signed.groupBy("key", "i", "j").applyInPandas(survivors, kept), "alike")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        return pd.DataFrame(
            links_between(
                frame["node"].tolist(),
                frame["part"].tolist(),
                frame["block"].tolist() if frame["i"].iloc[0] != frame["j"].iloc[0] else None,
                [np.frombuffer(x, np.uint64) for x in frame["members"]],
                percent,
            ),
            columns=["a", "b"],
        )

    return left.join(members, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def links_between(
    nodes: list[int], parts: list[int], blocks: list[int] | None, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Enough links to join all that the pairs of different parts (and blocks) join."""
    root = {p: p for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), bool)
    block = np.array(blocks) if blocks else None
    found = []
    for a in range(len(nodes) - 1):
        own = ids[starts[a] : starts[a] + sizes[a]]
        held[own] = True
        both = np.add.reduceat(held[ids[starts[a + 1] :]], starts[a + 1 :] - starts[a + 1], dtype=np.int64)
        held[own] = False
        alike = 100 * both >= percent * (sizes[a] + sizes[a + 1 :] - both)
        if block is not None:
            alike &= block[a + 1 :] != block[a]
        for b in (np.flatnonzero(alike) + a + 1).tolist():
            p, q = find(parts[a]), find(parts[b])
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((nodes[a], nodes[b]))
    return found


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` of every row; by id and hash a row is found again."""
    # pick: by it a row of each node is found again in a second reading of the texts.
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    texts = docs.select(
        doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.xxhash64(text)).alias("pick"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash")
    )
    rows = stage(
        texts.mapInArrow(_sign, "doc_id long, pick long, row long, text_hash long, n_shingles long, set_key binary, signature binary"), "signed"
    )
    nodes = rows.filter("n_shingles > 0").groupBy("set_key")
    nodes = nodes.agg(
        F.min("doc_id").alias("least"),
        F.min("pick").alias("pick"),
        F.min("row").alias("row"),
        F.max("n_shingles").alias("n"),
        F.max("signature").alias("signature"),
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # A set of one shingle is like no other set, so it needs no keys.
    keyed = nodes.filter("n > 1").select("node", "signature").mapInArrow(_keys, "key long, node long")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    hubs = stage(hubs.filter("hub < last"), "hubs")
    shared = stage(keyed.join(hubs, "key"), "shared")

    involved = stage(shared.select("node").distinct().join(nodes.select("node", "pick", "set_key"), "node"), "involved")
    members = _member_sets(texts.drop("row", "text_hash"), involved)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stage(_with_both(pairs, members, "members").mapInArrow(_confirm(percent), "a long, b long"), "links")

    led = confirmed(_leaders(shared, nodes))
    parts = involved.select("node").join(connected_components(led), "node", "left")
    rest = _open_keys(shared, parts.select("node", F.coalesce("component", "node").alias("part")))

    # What still shares a key across parts: pairs of small keys, and large keys in place.
    few = rest.filter(F.col("m") <= SMALL_KEY)
    x = few.select("key", F.col("node").alias("a"), F.col("part").alias("p"))
    y = few.select("key", F.col("node").alias("b"), F.col("part").alias("q"))
    pairs = x.join(y, "key").filter("a < b and p <> q").select("a", "b").distinct()
    near = confirmed(_with_both(pairs, nodes, "signature").mapInArrow(_agree, "a long, b long, agree long").select("a", "b"))
    crowded = rest.filter(F.col("m") > SMALL_KEY)
    within = stage(_within_blocks(_blocks(crowded, nodes, members, percent), nodes, members, percent), "links")

    whole = connected_components(led.unionByName(near).unionByName(within))
    named = nodes.select("set_key", "node", "least", "row").join(whole, "node", "left")
    # Nodes without links, which are nearly all, are not dealt by component.
    linked = stage(named.filter("component is not null"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("first"))
    linked = linked.select("set_key", "component").join(least, "component").select("set_key", "component_id", "first")
    alone = named.filter("component is null").select("set_key", F.col("least").alias("component_id"), F.col("row").alias("first"))
    named = linked.unionByName(alone)
    out = rows.select("doc_id", "row", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    first = F.col("doc_id").isNull() & component.isNull() & (F.col("row") == F.coalesce("first", F.col("row")))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False)) | first
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")
