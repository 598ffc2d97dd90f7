"""A Merkle manifest of a table: leaves by row, a tree for each source, a tree over the sources, and a proof for every row.

A leaf is the SHA-256 (lower-case hex) of a row's columns, each `-` if null, else its UTF-8 byte count, a colon and its
value. Leaves of a source ascend by id; while more than one node is left, every 16 consecutive ones become one node, the
SHA-256 of their hex digests. The roots of the sources, ordered by source (null first, bytewise), become one root alike.

Trees grow by events: a task takes nodes in any order and holds partial parents, keyed by (tree, level, index), that
gather digests by child index. How many children a parent has follows from the size of its tree, so a parent is made the
moment its last child arrives, and may complete its own parent at once. Rows reach the first round in order, so whole
subtrees are made where their leaves are; only nodes whose parents wait for children elsewhere are dealt anew by parent,
round by round, until no node waits. Proofs go down the links from parents to children, one join a level, and the last one
hashes them run by run: what is above a run is sent once for its 16 leaves.

Numbers of rows in their trees come from ranges in order, with offsets by range: a source of any share is in many ranges.

Null ids come first in their source and are never tampered with in the query; a null source is a source of its own. Rows
of equal id in a source are ordered by their leaves; equal rows are leaves of their own, side by side. An empty text is
`0:`. A lone leaf is its source's root, and a lone source's root is the root. An empty table has no rows and no root.
Columns other than those hashed do not matter, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lagloom.llm.common import scratch, spread, stored

#: Children of a node.
ARITY = 16
#: The columns of documents that a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*fields: Column) -> Column:
    """The hex digest of the leaf that has these values."""
    held = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*held).cast("binary"), 256)


def numbered(df: DataFrame, tree: str, order: list[str], held) -> DataFrame:
    """df with idx, the place of each row among those of its tree by order, and n, their number. Rows are put in ranges
    by tree and order; a row's place in its range and the rows of its tree in earlier ranges make its number."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    at = F.monotonically_increasing_id()
    rows = held(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumns({"range": F.shiftright(at, 33), "place": at.bitwiseAND((1 << 33) - 1)}), "ranges")
    parts = rows.groupBy(F.col(tree).alias("t"), F.col("range").alias("r")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    over = Window.partitionBy("t")  # a row for each range that a tree is in
    before = F.coalesce(F.sum("rows").over(over.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("t", "r", (before - F.col("first")).alias("shift"), F.sum("rows").over(over).alias("n"))
    met = rows.join(parts, (F.col("range") == F.col("r")) & F.col(tree).eqNullSafe(F.col("t")))
    return met.withColumn("idx", F.col("place") + F.col("shift")).drop("t", "r", "shift", "range", "place")


def _digest(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def _grow(schema: StructType):
    """One round: nodes in, parents that are complete and nodes that still wait out."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        partial: dict[tuple, dict[int, tuple]] = {}
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(target)], schema=target)
            made.clear()
            return out

        def arrive(tree, level, idx, n, digest, id, other, children, ids, others) -> None:
            """A node comes into being, or comes from another task: it is its tree's root, or its parent gathers it."""
            while True:
                here = -(-n // ARITY**level)
                if here == 1:
                    made.append((tree, level, idx, n, digest, id, other, children, ids, others, 0))
                    return
                key = (tree, level + 1, idx // ARITY)
                gathered = partial.setdefault(key, {})
                gathered[idx % ARITY] = (tree, level, idx, n, digest, id, other, children, ids, others)
                if len(gathered) < min(ARITY, here - idx // ARITY * ARITY):
                    return
                run = [x for _, x in sorted(partial.pop(key).items())]
                made.extend((*x, 0) for x in run if x[7] is not None)
                children, ids, others = [x[4] for x in run], None if level else [x[5] for x in run], None if level else [x[6] for x in run]
                level, idx, digest, id, other = level + 1, idx // ARITY, _digest(children), None, None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names[:-1]), strict=True):
                arrive(*row)
            if len(made) > 5000:
                yield flush()
        made.extend((*x, 1) for gathered in partial.values() for x in gathered.values())
        if made:
            yield flush()

    return run


def grown(leaves: DataFrame, held) -> DataFrame:
    """All nodes that have children, and lone leaves, of the trees whose leaves these are: (tree, level, idx, n, digest,
    id, other, children, ids, others). leaves: (tree, idx, n, digest, id, other), digests and others as bytes; `other`
    and `id` are kept for the leaves of each run."""
    kinds = {f.name: f.dataType for f in leaves.schema}
    node = [("tree", kinds["tree"]), ("level", IntegerType()), ("idx", LongType()), ("n", LongType()), ("digest", BinaryType()), ("id", kinds["id"]), ("other", BinaryType())]
    node += [("children", ArrayType(BinaryType())), ("ids", ArrayType(kinds["id"])), ("others", ArrayType(BinaryType()))]
    schema = StructType([StructField(*x) for x in node] + [StructField("open", IntegerType())])
    empty = {"level": F.lit(0), "children": F.lit(None), "ids": F.lit(None), "others": F.lit(None), "open": F.lit(1)}
    waiting = leaves.select(*[(empty[f.name] if f.name in empty else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])
    done = []
    while True:
        nodes = held(waiting.mapInArrow(_grow(schema), schema), "nodes")
        done.append(nodes.where("open = 0").drop("open"))
        waiting = nodes.where("open = 1")
        if waiting.isEmpty():
            break
        waiting = spread(waiting.withColumn("parent", F.floor(F.col("idx") / ARITY)), "tree", "level", "parent").drop("parent")
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return whole


def _step(pos: int, run: list[bytes]) -> bytes:
    """One level of a path: the place of a node in its run, then the digests beside it."""
    return bytes([pos]) + b"".join(run[:pos] + run[pos + 1 :])


def _steps(run: str) -> Column:
    """_step for every node of a run, as an expression."""
    beside = lambda k: F.aggregate(F.filter(run, lambda _, j: j != k), F.lit(b""), lambda a, b: F.concat(a, b))
    return F.transform(run, lambda _, k: F.concat(F.unhex(F.lpad(F.hex(k), 2, "0")), beside(k)))


def paths_down(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, children, ids, others, path, subroot) of every run of leaves, and of lone leaves as runs of one that no
    level stands above. roots: (tree, path, subroot), the path above each tree's root. A join for each level."""
    height = nodes.agg(F.max("level")).first()[0]
    if height is None:
        height = 0
    columns = ["tree", "children", "ids", "others", "path", "subroot"]
    tops = nodes.where(F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))).join(roots, F.col("tree").eqNullSafe(F.col("root_of"))).drop("root_of")
    lone = tops.where("level = 0").select("tree", F.array("digest").alias("children"), F.array("id").alias("ids"), F.array("other").alias("others"), "path", "subroot", F.lit(True).alias("lone"))
    known, found = None, [lone]
    for level in range(height, 0, -1):
        own = tops.where(F.col("level") == level).select("idx", *columns)
        if known is not None:
            here = nodes.where((F.col("level") == level) & (F.col("n") > ARITY**level)).select(F.col("tree").alias("t"), F.col("idx").alias("i"), "children", "ids", "others")
            met = here.join(known, (F.col("idx") == F.col("i")) & F.col("tree").eqNullSafe(F.col("t")))
            own = own.union(met.select("idx", *columns))
        if level > 1:
            below = own.select("tree", "path", "subroot", "idx", F.posexplode(_steps("children")).alias("pos", "step"))
            known = below.select("tree", (F.col("idx") * ARITY + F.col("pos")).alias("idx"), F.concat(F.array("step"), "path").alias("path"), "subroot")
        else:
            found.append(own.select(*columns, F.lit(False).alias("lone")))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _climbed(digest: bytes, path: list[bytes]) -> bytes:
    for step in path:
        others = [step[k : k + 32] for k in range(1, len(step), 32)]
        digest = _digest(others[: step[0]] + [digest] + others[step[0] :])
    return digest


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "leaf": [], "subroot": [], "proof_sha256": [], "folded_root": []}
        for children, ids, others, path, subroot, lone in zip(*(batch.column(c).to_pylist() for c in ("children", "ids", "others", "path", "subroot", "lone")), strict=True):
            above = "".join(step[1:].hex() for step in path).encode()
            hexes, top = [c.hex() for c in children], None
            for k, (digest, id, other) in enumerate(zip(children, ids, others, strict=True)):
                beside = "".join(hexes[:k] + hexes[k + 1 :]).encode()
                own = [] if lone else [_step(k, children)]
                if other is not None:
                    folded = _climbed(other, own + path)
                else:
                    folded = top = top or _climbed(digest, own + path)
                for name, v in zip(out, (id, digest.hex(), subroot.hex(), sha256(beside + above).hexdigest(), folded.hex()), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field("ids").type.value_type if c == "doc_id" else pa.string()) for c, v in out.items()], list(out))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs; fields are its columns
    for id, source and whatever else a leaf holds, the text last. Where the condition `tampered` holds, folded_root
    starts from the leaf whose text has A-Z lower-cased; verified says whether folded_root is root."""
    spark = docs.sparkSession
    id_, source, text = (F.col(c) for c in (fields[0], fields[1], fields[-1]))
    values = [F.col(c) for c in fields]
    own, folded = leaf(*values), leaf(*values[:-1], F.translate(text.cast("string"), UPPER, LOWER))
    other = F.when(tampered & (folded != own), F.unhex(folded)) if tampered is not None else F.lit(None).cast("binary")
    kind = docs.schema[fields[0]].dataType
    out = StructType([StructField("doc_id", kind), *(StructField(c, StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
    with scratch(spark) as held:
        rows = held(docs.select(source.cast("string").alias("tree"), id_.alias("id"), F.unhex(own).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
        nodes = grown(numbered(rows, "tree", ["id", "digest", "row"], held), held)
        is_root = F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))
        sources = nodes.where(is_root).select(F.lit(0).alias("tree"), F.col("tree").alias("id"), "digest", F.lit(None).cast("binary").alias("other"))
        above = grown(numbered(sources, "tree", ["id"], held), held)
        root = above.where(is_root).select("digest").first()
        top = above.sparkSession.createDataFrame([(0, [], b"")], "root_of int, path array<binary>, subroot binary")
        runs = paths_down(above, top).select(F.arrays_zip(F.col("children").alias("digest"), F.col("ids").alias("id")).alias("x"), "path", "lone", F.when(~F.col("lone"), _steps("children")).alias("steps"))
        each = runs.select("path", "lone", "steps", F.posexplode("x").alias("pos", "x"))
        roots = each.select(F.col("x.id").alias("root_of"), F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(F.get("steps", F.col("pos"))), "path")).alias("path"), F.col("x.digest").alias("subroot"))
        done = paths_down(nodes, held(roots, "roots")).mapInArrow(_proofs, out)
        hex_root = F.lit(bytes(root[0]).hex() if root else None).cast("string")
        done = done.select("doc_id", "leaf", "subroot", hex_root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == hex_root).alias("verified"))
        return stored(done, "manifest")
