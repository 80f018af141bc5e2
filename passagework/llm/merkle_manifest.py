"""A Merkle manifest of a dataset: a root, and a proof for every row, by aligned blocks.

Leaves are digests of rows; the rows themselves are never shuffled. They are placed in
the order of their group and id by ranges (no task has a whole group), and the ``BLOCK`` =
16^3 leaves of one aligned block meet in one row. There their hex digests are one
contiguous numpy matrix: reshaped by fanout, each row is one run to hash, and so on by
levels; a node's siblings are the bytes before and after it in its run, found by index
arithmetic alone. A block's digest is a node of the next round, which has a 4096th as many,
until each group has one node; groups' nodes go through the same rounds, up to the root.

Paths come back down the rounds: a block's path to the root is joined to it once, and its
leaves' own three levels come from its matrices. So a round shuffles digests only, and a
group of any size is dealt out by blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
HEX = 64
#: Equal rows are dealt to this many ranges at most.
TIES = 64
PATH = "array<struct<left:string,right:string>>"


def field_digest(*fields: Column) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon, the value."""
    framed = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Inside a block.


def tree(leaves: np.ndarray, levels: int | None) -> list[np.ndarray]:
    """The matrices of hex digests, from (n, 64) leaves up through so many levels, or up to
    one node if that is None."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        nodes = out[-1]
        whole = len(nodes) // FANOUT * FANOUT
        runs = [*nodes[:whole].reshape(-1, FANOUT * HEX), *([nodes[whole:].reshape(-1)] if whole < len(nodes) else [])]
        digests = b"".join(hashlib.sha256(run).hexdigest().encode() for run in runs)
        out.append(np.frombuffer(digests, np.uint8).reshape(-1, HEX))
    return out


def path_of(matrices: list[bytes], k: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after node ``k`` in its run, and so on for its ancestors."""
    out = []
    for nodes in matrices[:-1]:
        first = k // FANOUT * FANOUT * HEX
        out.append((nodes[first : k * HEX], nodes[(k + 1) * HEX : first + FANOUT * HEX]))
        k //= FANOUT
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _levels(total: int) -> int | None:
    return None if total <= BLOCK else LEVELS


def _lists(column: pa.ListArray):
    """The bounds of each list in what ``flatten`` gives."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)


def _matrix(digests: pa.StringArray) -> np.ndarray:
    """Digests side by side in memory, as they are in the Arrow buffer."""
    return np.frombuffer(digests.buffers()[2], np.uint8, len(digests) * HEX, digests.offset * HEX).reshape(-1, HEX)


def _climb(batches):
    for batch in batches:
        digests, tops = batch.column(3).flatten(), []
        for (at, n), total in zip(_lists(batch.column(3)), batch.column(2).to_pylist(), strict=True):
            tops.append(tree(_matrix(digests.slice(at, n)), _levels(total))[-1].tobytes().decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.string())], ["grp", "block", "total", "digest"])


def _path_pairs(path) -> list[tuple[bytes, bytes]]:
    return [(x["left"].encode(), x["right"].encode()) for x in path]


def _descend(batches):
    """(key, pos, path, top) of each node of a block, its path that of the block and before it its own."""
    for batch in batches:
        members = batch.column(3).flatten()
        keys, places, digests = (members.field(k) for k in ("carried", "pos", "digest"))
        for (at, n), total, above, top in zip(_lists(batch.column(3)), batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            matrices = [m.tobytes() for m in tree(_matrix(digests.slice(at, n)), _levels(total))]
            own = [[{"left": a.decode(), "right": b.decode()} for a, b in path_of(matrices, k)] + above for k in range(n)]
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            yield pa.RecordBatch.from_arrays([keys.slice(at, n), places.slice(at, n), pa.array(own, kind), pa.array([top] * n, pa.string())], ["carried", "pos", "path", "top"])


def _proofs(root: str):
    goal = root.encode()

    def run(batches):
        for batch in batches:
            members = batch.column(3).flatten()
            ids, digests, claims = (members.field(k) for k in ("carried", "digest", "claim"))
            for (at, n), total, above, top in zip(_lists(batch.column(3)), batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                leaves, upper = _matrix(digests.slice(at, n)), _path_pairs(above)
                matrices, tail = [m.tobytes() for m in tree(leaves, _levels(total))], b"".join(a + b for a, b in upper)
                proofs, folded = [], []
                for k, claim in enumerate(claims.slice(at, n).to_pylist()):
                    own = path_of(matrices, k)
                    proofs.append(hashlib.sha256(b"".join(a + b for a, b in own) + tail).hexdigest())
                    leaf = claim.encode() if claim is not None else matrices[0][k * HEX : (k + 1) * HEX]
                    folded.append(fold(leaf, own + upper))
                same = lambda x: pa.array([x] * n, pa.string())  # noqa: B023, E731
                columns = [ids.slice(at, n), digests.slice(at, n), same(top), same(root), pa.array(proofs), pa.array([f.decode() for f in folded]), pa.array([f == goal for f in folded])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


# Rounds over blocks.


def _local_places(batches):
    """The place of each row among those of its group in this sorted range."""
    last, nth = None, 0
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
        begins = np.zeros(len(groups), np.int64)
        begins[new] = new
        places = np.arange(len(groups)) - np.maximum.accumulate(begins)
        if len(groups):
            first = int(new[1]) if len(new) > 1 else len(groups)
            if groups[0] == last:
                places[:first] += nth
            last, nth = groups[-1], int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "nth"])


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp first) with ``pos``, their place in their group from 0, and ``total``,
    how many their group has. Ranges are written, so a lost task can't deal them anew."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt.mapInArrow(_local_places, f"{kind}, part int, nth long"), "merkle-order")
    sizes = dealt.groupBy("grp", "part").agg(F.count("*").alias("size"))
    whole = Window.partitionBy("grp")
    before = sizes.select("grp", "part", (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("total"))
    joined = dealt.join(before, ["grp", "part"])
    return joined.select(*rows.columns, (F.col("before") + F.col("nth")).alias("pos"), "total")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """grp, block, total, members in order, from nodes (grp, pos, total, carried, digest)."""
    member = F.struct("pos", "digest", "carried", *more)
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"))
    return materialise(grouped.agg(F.max("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members")), "merkle-blocks")


@dataclass(frozen=True)
class Forest:
    """The rounds of many trees: their blocks, and per round the trees that ended there."""

    rounds: list[DataFrame]  # grp, block, total, members
    tops: list[DataFrame]  # grp, digest

    @property
    def roots(self) -> DataFrame:
        out = self.tops[0]
        for more in self.tops[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The blocks of the first round with ``path`` and ``top``, given those of each tree."""
        below = None
        for blocks, tops in zip(self.rounds[::-1], self.tops[::-1], strict=True):
            ended = tops.join(above, "grp").select("grp", F.lit(0).cast("long").alias("block"), "path", "top")
            all_of = ended if below is None else ended.unionByName(below)
            here = blocks.join(all_of, ["grp", "block"]).select("grp", "block", "total", "members", "path", "top")
            below = here.mapInArrow(_descend, f"carried string, pos long, path {PATH}, top string").select(F.col("carried").alias("grp"), F.col("pos").alias("block"), "path", "top") if blocks is not self.rounds[0] else None
        return here


def _grown(blocks: DataFrame) -> Forest:
    rounds, tops = [blocks], []
    while True:
        only = rounds[-1].select("grp", "block", "total", F.transform("members", lambda m: m["digest"]).alias("digests"))
        climbed = materialise(only.mapInArrow(_climb, "grp string, block long, total long, digest string"), "merkle-climbed")
        tops.append(climbed.filter(F.col("total") <= BLOCK).select("grp", "digest"))
        rest = climbed.filter(F.col("total") > BLOCK)
        if rest.isEmpty():
            return Forest(rounds, tops)
        total = F.ceil(F.col("total") / BLOCK)
        rounds.append(_blocks(rest.select("grp", F.col("block").alias("pos"), total.alias("total"), F.col("grp").alias("carried"), "digest")))


def prove(leaves: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of (grp,
    id, leaf, claim).

    A group's leaves ascend by id, nulls first, rows of one id by their leaf; groups ascend
    bytewise, nulls first. ``folded_root`` is made of the claim (of the leaf, where the claim is
    null) and the leaf's siblings, and ``verified`` says whether it is the root. Equal rows
    are leaves of their own; without rows there is no root and no row.
    """
    group = F.coalesce(F.concat(F.lit("+"), F.col("grp")), F.lit(""))
    kept = materialise(leaves.select(group.alias("grp"), F.col("id").cast("long").alias("carried"), F.col("leaf").alias("digest"), "claim", (F.monotonically_increasing_id() % TIES).cast("byte").alias("tie")), "merkle-leaves")
    docs = _grown(_blocks(_placed(kept, ["carried", "digest", "tie"]), "claim"))
    subroots = docs.roots.select(F.lit("").alias("grp"), F.col("grp").alias("carried"), "digest")
    top = _grown(_blocks(_placed(subroots, ["carried"])))
    found = top.roots.first()  # one row: all groups are one tree
    if found is None:
        return leaves.sparkSession.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    sources = top.paths(top.roots.select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("top")))
    per_source = sources.mapInArrow(_descend, f"carried string, pos long, path {PATH}, top string").select(F.col("carried").alias("grp"), "path")
    above = materialise(per_source.join(docs.roots, "grp").select("grp", "path", F.col("digest").alias("top")), "merkle-groups")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.paths(above).mapInArrow(_proofs(found.digest), schema)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf and what ``prove`` gives for every row of ``documents``, by source.

    Where ``tampered`` is true, the claim is made of the text with A-Z in lower case.
    Nulls in any column are part of the digest; other columns are ignored; see ``prove``
    for repeated rows, null ids and empty tables.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claim = F.when(tampered, field_digest(*own, lower_ascii(F.col("text")))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), field_digest(*own, F.col("text")).alias("leaf"), claim.alias("claim"))
    return prove(rows).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    """The same by SQL, level by level: ``n<k>`` are the nodes of level k, ``f<k>`` each
    document's claim folded so far and its proof. A group that has one node rests."""
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    table = "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i)))"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1])), 4294967295)"
    parts = [
        f"crc_table AS (SELECT {table} AS t)",
        f"leaves AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS claim FROM documents, crc_table)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, doc_id, claim FROM leaves)",
        "f0 AS (SELECT doc_id, g, pos, digest AS leaf, claim AS cur, '' AS proof FROM n0)",
    ]

    def climb(a: str, b: str, f: str, f2: str) -> list[str]:
        return [
            f"r{b} AS (SELECT g, pos // {FANOUT} AS run, list(digest ORDER BY pos) AS ds, any_value(many) AS many FROM (SELECT *, count(*) OVER (PARTITION BY g) > 1 AS many FROM {a}) GROUP BY g, run)",
            f"{b} AS (SELECT g, run AS pos, CASE WHEN many THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest FROM r{b})",
            f"{f2} AS (SELECT doc_id, {f}.g, leaf, {f}.pos // {FANOUT} AS pos, CASE WHEN many THEN sha256(array_to_string(ds[1:{f}.pos % {FANOUT}], '') || cur || array_to_string(ds[{f}.pos % {FANOUT} + 2:], '')) ELSE cur END AS cur, CASE WHEN many THEN proof || array_to_string(ds[1:{f}.pos % {FANOUT}], '') || array_to_string(ds[{f}.pos % {FANOUT} + 2:], '') ELSE proof END AS proof{', subroot' if f.startswith('s') else ''} FROM {f} JOIN r{b} ON {f}.g IS NOT DISTINCT FROM r{b}.g AND {f}.pos // {FANOUT} = run)",
        ]

    depth = 6  # 16^6 leaves a source
    for k in range(depth):
        parts += climb(f"n{k}", f"n{k + 1}", f"f{k}", f"f{k + 1}")
    parts += [
        f"m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, digest, g AS source FROM n{depth})",
        f"s0 AS (SELECT doc_id, 0 AS g, m0.pos, leaf, cur, proof, digest AS subroot FROM f{depth} JOIN m0 ON f{depth}.g IS NOT DISTINCT FROM m0.source)",
    ]
    for k in range(3):  # 16^3 sources
        parts += climb(f"m{k}", f"m{k + 1}", f"s{k}", f"s{k + 1}")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified FROM s3, m3"


ORACLE_SQL = _sql()
