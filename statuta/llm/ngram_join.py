"""Similarity join of documents by the Jaccard coefficient of their word n-gram sets.

Rows of the document by n-gram incidence matrix that link have, by their sizes, so many n-grams in common that they share
one of the first few of each, whatever order the n-grams of all documents are in: of x n-grams the first x - ceil(t x) + 1.
With EXTRA more they share 1 + EXTRA (fewer if they have fewer in common), so a row that is in EXTRA large columns at most
meets what it links with in a small one too, and leaves the large ones.
Those are the columns that a row is multiplied in; rows that share none are never looked at. The order puts n-grams last
that are frequent in some of the documents (at most FREQUENT of them, broadcast), so that a passage which many documents
share makes no candidates; it changes the work, not the result. Columns with the same rows count once. Where rows meet in
a column, what they have in common stands in both behind it, if it is among the first 1 + EXTRA that they share, but for
EXTRA: pairs whose tails from there on are too short for their sizes go before anything is sent for them.

Sets that are equal become one row before anything is joined. In a column of at most FEW rows these are compared with each
other; the rows of any other are not expanded into pairs: each is tried with one centre. First by bitmaps, in which every
column block with n-grams of a row is a bit: each bit that the other row lacks is an n-gram that is missing, and over the
bound that follows from the sizes the pair goes. What is left is multiplied column block by column block, where overlaps
add up and a row goes as soon as the columns left cannot bring it to the bound. Rows that link form components, and only
columns that still hold several components go on (with another centre, where ROUNDS allows more turns), column by column in
blocks of BLOCK rows, those outside the largest component with all, in the same two steps; a block gives links that join
its components, not all that there are. So every component is exact, near copies cost a few candidates for each row, and
beyond columns of FEW rows no pair is shuffled but those with a centre. The rows of a hot column are dealt into SALTS parts
with a centre each, and these are tried with one.

Defined results: null and empty texts have an empty set, 0 n-grams, and link with nothing; a text of fewer than n
words is one n-gram; repeated rows each give a row; rows that share an id count as linked; a row without an id is
a component of its own, without a number; a very long text is one row of the matrix, taken whole; of ties the smallest id
names the component; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import HOT, join_hot, joined, mix, prepare, run_hashes, slices, text_bytes, tidy, trim, word_hashes, written
from statuta.llm.components import components

_STEP = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0x165667B19E3779F9)
#: Turns over the columns that still hold several components, the last of them by blocks; then rows of a block, and columns of one step, of the blocked matrix product.
ROUNDS, BLOCK, COLUMNS = 1, 2048, 8192
#: N-grams a row in a block: of longer texts it has fewer rows, so that its sets take 8 bytes x BLOCK x MEAN a side.
MEAN = 512
#: One row in so many is looked at for frequent n-grams and hot columns; parts that the rows of a hot one are dealt into.
SOME, SALTS = 32, 64
#: Column blocks of a bitmap for each n-gram of its set.
BITS = 2
#: Columns of so many rows at most are looked at at once, whole; others are large. Columns a row beyond the first that it needs.
FEW, EXTRA = 16, 3
#: Bound of the n-grams that are broadcast as frequent ones.
FREQUENT = 1 << 20


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, counts = word_hashes(*joined(texts), fold=True)
    grams, out, at = run_hashes(hashes, n), [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        else:  # the whole sequence, told apart from longer runs by its length
            out.append(mix(run_hashes(hashes[at : at + c], c) + np.full(1, c, np.uint64)) if c else np.empty(0, np.uint64))
        at += c
    return out


def prefix(grams: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of a set, of which any set that may link with it has 1 + EXTRA, or all that both have in common, among its first: rare ones by hash, then frequent ones."""
    n = len(grams) - -(-num * len(grams) // den) + 1 + EXTRA
    if not len(frequent):
        return grams[:n]
    last = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
    rare = grams[~last][:n]
    return np.concatenate((rare, grams[last][: n - len(rare)]))


def bitmap(grams: np.ndarray, bits: int = BITS) -> bytes:
    """A bit for each of 2**k column blocks (by the first bits of the n-grams) that has n-grams of a set; at least so many blocks for each."""
    k = max(6, (bits * len(grams) - 1).bit_length())
    out = np.zeros(1 << k, bool)
    out[grams >> np.uint64(64 - k)] = True
    return np.packbits(out).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) of this many bytes that say the same of larger blocks."""
    while bits.shape[1] > size:
        wide = np.unpackbits(bits, axis=1)
        bits = np.packbits(wide[:, ::2] | wide[:, 1::2], axis=1)
    return bits


def possible(n: np.ndarray, bits: list[bytes], m: np.ndarray, others: list[bytes], num: int, den: int, tails: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of two lists of rows (sizes and bitmaps; tails: n-grams from a common one on) the pairs that may link."""
    tail, behind = tails or (n, m)
    sizes, found = [np.fromiter(map(len, b), np.int64, len(b)) for b in (bits, others)], []
    classes = [{k: (at := np.flatnonzero(s == k), np.frombuffer(b"".join([b[i] for i in at.tolist()]), np.uint8).reshape(len(at), k)) for k in np.unique(s).tolist()} for s, b in zip(sizes, (bits, others), strict=True)]
    for k, (at, a) in classes[0].items():
        for j, (of, b) in classes[1].items():
            if j > 4 * k or k > 4 * j:
                continue  # neither set is large enough for the other
            x, y = fold(a, min(j, k)), fold(b, min(j, k))
            for r, i in enumerate(at.tolist()):
                need = -(-num * (n[i] + m[of]) // (num + den))
                some = np.flatnonzero(need <= np.minimum(tail[i], behind[of]))
                own = y[some]
                ok = np.bitwise_count(x[r] & ~own).sum(axis=1) <= n[i] - need[some]
                some, own = some[ok], own[ok]
                some = some[np.bitwise_count(own & ~x[r]).sum(axis=1) <= m[of[some]] - need[some]]
                found.append((np.full(len(some), i), of[some]))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [])))


def tail_of(size: Column | str, place: Column | str) -> Column:
    """N-grams of a set that may be common to a row met in a column: those from it on and EXTRA; place holds 31 bits of where it stands."""
    size, place = (F.col(c) if isinstance(c, str) else c for c in (size, place))
    return F.least(size, size - place.bitwiseAND(F.lit(2**31 - 1)) + EXTRA)


def near(x: str, y: str, num: int, den: int) -> Column:
    """Whether two rows (their prefixes: `size` and `tail`) can link with this column as the first that they share: what they
    have in common stands in both tails. Two rows that link pass in the first 1 + EXTRA columns that they share."""
    return F.least(f"{x}tail", f"{y}tail") * (num + den) >= (F.col(f"{x}size") + F.col(f"{y}size")) * num


def product(row: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of some rows of the incidence matrix (sorted sets) link with one row: the matrix product of these rows with
    that one, column block by column block. Overlaps add up, and a row goes as soon as the columns left cannot bring it
    to the bound that follows from the sizes any more."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    need = -(-num * (sizes + len(row)) // (num + den))
    alive = np.flatnonzero(need <= np.minimum(sizes, len(row)))
    counts, gone = np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
    for lo in range(0, len(row), COLUMNS) if len(alive) else ():
        block = row[lo : lo + COLUMNS]
        to = None if lo + COLUMNS >= len(row) else row[lo + COLUMNS]
        ends = [len(others[i]) if to is None else int(np.searchsorted(others[i], to)) for i in alive.tolist()]
        parts = [others[i][gone[i] : end] for i, end in zip(alive.tolist(), ends, strict=True)]
        columns = np.concatenate(parts)
        at = np.minimum(np.searchsorted(block, columns), len(block) - 1)
        hits = np.concatenate(([0], np.cumsum(block[at] == columns)))
        cuts = np.cumsum([0, *map(len, parts)])
        counts[alive] += hits[cuts[1:]] - hits[cuts[:-1]]
        gone[alive] = ends
        left = np.minimum(sizes[alive] - gone[alive], max(len(row) - lo - COLUMNS, 0))
        alive = alive[counts[alive] + left >= need[alive]]
        if not len(alive):
            break
    out = np.zeros(len(others), bool)
    out[alive] = True
    return out


@tidy
def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: its id, n_shingles and component_id, the smallest id that links reach from it.

    Two sets link when den * intersection >= num * union."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_text"):
            yield pa.record_batch({"gram": np.concatenate(shingle_sets(text_bytes(batch, "_text"), n)).view(np.int64)})

    some = F.pmod(F.xxhash64(id_col), F.lit(SOME)) == 0
    often = docs.where(some).select("_text").mapInArrow(listed, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    often = often.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()["gram"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_text"):
            sets = shingle_sets(text_bytes(batch, "_text"), n)
            marks = [prefix(s, sent.value, num, den) if len(s) else s for s in sets]
            lens = np.cumsum([0, *map(len, marks)])
            side = lambda salt: pa.array([int(mix(s ^ salt).sum()) - 2**63 for s in sets], pa.int64())
            sigs = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(marks).view(np.int64)) if marks else pa.array([], pa.int64()))
            bits = pa.array([bitmap(s) for s in sets], pa.binary())
            yield pa.record_batch({"id": batch.column(id_col), "n": pa.array(map(len, sets), pa.int64()), "hi": side(_LEVEL), "lo": side(_STEP), "sigs": sigs, "bits": bits})
        trim()

    rows = written(docs.mapInArrow(sketch, f"id {kind}, n long, hi long, lo long, sigs array<long>, bits binary"), "sketches")
    sent.unpersist()
    full = rows.where("n > 0 and id is not null")
    nodes = full.groupBy("hi", "lo").agg(F.min(F.struct("id", "n", "sigs", "bits")).alias("x")).select("hi", "lo", "x.*")
    nodes = written(nodes.withColumnRenamed("id", "node"), "nodes")
    # columns with over one in HOT of all entries are HOT at most; counted on some rows, as this only decides how rows are dealt
    some = full.where(F.pmod(F.xxhash64("id"), F.lit(SOME)) == 0).select(F.explode("sigs").alias("sig"))
    hot = some.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") * HOT > some.count()).select("sig", F.lit(True).alias("hot"))
    members = nodes.select("node", F.col("n").alias("size"), F.posexplode("sigs").alias("at", "sig"))
    salted = members.join(F.broadcast(hot), "sig", "left").select("sig", "node", F.expr("shiftleft(size, 31) + at").alias("place"), F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(-1).cast("int").alias("salt"))
    own = Window.partitionBy("sig", "salt")
    size = F.expr("shiftright(place, 31)")  # one column is shuffled for two
    placed = salted.withColumn("last", F.max("node").over(own)).withColumn("rows", F.count("*").over(own)).withColumn("first", F.min(F.struct("node", "place")).over(own))
    placed = placed.where("salt >= 0 or first.node < last").withColumn("size", size).withColumn("tail", tail_of("size", "place"))
    first_size = F.expr("shiftright(first.place, 31)")
    first = F.struct(F.col("first.node").alias("node"), first_size.alias("size"), tail_of(first_size, "first.place").alias("tail"))
    large = (F.col("salt") >= 0) | (F.col("rows") > FEW)
    buckets = written(placed.select("sig", "node", "size", "tail", first.alias("first"), "salt", large.alias("large")), "columns")
    heavy = buckets.where("large").groupBy("node").agg(F.count("*").alias("large"), F.max("size").alias("size"))
    heavy = heavy.where((F.col("large") > EXTRA) | (F.col("large") * den >= F.col("size") * num)).select("node")
    buckets = buckets.drop("large")
    rows_of = [F.count("*").alias("n"), F.sum("tail").alias("tails"), *(F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2))]
    once = buckets.groupBy("sig").agg(*rows_of).groupBy("n", "s0", "s1").agg(F.max(F.struct("tails", "sig")).alias("x")).select("x.sig", "n")  # the first in the order
    buckets = written(join_hot(buckets, written(once, "once"), ["sig"]).withColumnRenamed("n", "rows"), "buckets")
    found = links(docs.withColumnRenamed(id_col, "node"), nodes.select("node", "n", "bits"), buckets, heavy, n, num, den, kind)
    heads = nodes.select("hi", "lo", "node")
    classes = heads.join(found, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component_id"))
    rest = rows.where("n = 0 or id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.join(classes, ["hi", "lo"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").unionByName(rest)


def links(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, heavy: DataFrame, n: int, num: int, den: int, kind: str) -> DataFrame:
    """Components (node, component) of the nodes in buckets (sig, rows that it has, node, size, tail, and of its salt the first node), from links counted;
    heavy: the nodes that have to stay in large columns."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="_text"):
            yield pa.record_batch({"node": batch.column("node"), "grams": pa.array([s.tobytes() for s in shingle_sets(text_bytes(batch, "_text"), n)], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column(c)] for c in ("x", "y"))
            centres = batch.column("a").to_pylist()
            hit, at = [], 0
            while at < len(x):
                to = at + 1
                while to < len(x) and centres[to] == centres[at]:
                    to += 1
                hit.append(product(x[at], y[at:to], num, den))
                at = to
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate([np.zeros(0, bool), *hit])))
        trim()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            x, y, centres = (batch.column(c).to_pylist() for c in ("x", "y", "a"))
            hit, at = [], 0
            while at < len(x):
                to = at + 1
                while to < len(x) and centres[to] == centres[at]:
                    to += 1
                hit.append(possible(n[at : at + 1], x[at : at + 1], m[at:to], y[at:to], num, den)[1] + at)
                at = to
            yield batch.select(["a", "b"]).take(pa.array(np.sort(np.concatenate([np.empty(0, np.int64), *hit]))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of small columns that may link by sizes and tails; a column's rows follow each other."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            sig = rows["sig"].to_numpy()
            cut = int(np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))[-1])
            rest = rows.slice(cut)
            yield from pairs_of(rows.slice(0, cut))
        if rest is not None:
            yield from pairs_of(rest)

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        sig, size, tail = (rows[c].to_numpy() for c in ("sig", "size", "tail"))
        for step in range(1, FEW):
            p = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(p):
                break
            q = p + step
            ok = np.minimum(tail[p], tail[q]) * (num + den) >= num * (size[p] + size[q])
            yield pa.record_batch([rows["node"].combine_chunks().take(pa.array(k[ok])) for k in (p, q)], names=["a", "b"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets (node, grams) of some nodes."""
        return written(docs.join(wanted, "node").dropDuplicates(["node"]).mapInArrow(sets, f"node {kind}, grams binary"), "sets")

    def counted(pairs: DataFrame) -> DataFrame:
        """The links among pairs that may link."""
        pairs = written(pairs, "pairs")
        wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        grams = sets_of(wanted)
        x, y = grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(count, f"a {kind}, b {kind}")  # sorted by a

    def screened(pairs: DataFrame) -> DataFrame:
        x = nodes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
        y = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        return pairs.where("a <> b").distinct().join(y, "b").join(x, "a").mapInArrow(screen, f"a {kind}, b {kind}")  # sorted by a

    small = buckets.where(F.col("rows") <= FEW).select("sig", "node", "size", "tail").repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(whole, f"a {kind}, b {kind}")
    buckets = written(buckets.where(F.col("rows") > FEW).join(heavy, "node", "left_semi"), "large")
    firsts = buckets.where("salt >= 0").select("sig", "first.*").distinct()  # SALTS for each hot column at most
    centre = F.broadcast(firsts.groupBy("sig").agg(F.min(F.struct("node", "size", "tail")).alias("first")))
    with_first = buckets.select("sig", "node", "size", "tail", "first").unionByName(firsts.join(centre, "sig"))
    pairs = with_first.where(near("first.", "", num, den)).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    edges, state, open_ = written(counted(screened(pairs.unionByName(small))), "links"), None, buckets.select("sig", "node", "size", "tail")
    if edges.take(1):
        state = components(edges)
    for turn in range(1, ROUNDS + 1):
        labelled = open_.withColumn("component", F.col("node")) if state is None else open_.join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = labelled.groupBy("sig").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n")).where("p < q").select("sig", "n")
        labelled = written(join_hot(labelled, written(apart, "apart"), ["sig"]).drop("n"), "open")  # buckets that hold one component are done
        open_ = labelled.drop("component")
        if not labelled.take(1):
            break
        if turn < ROUNDS:
            centres = labelled.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "component", "size", "tail")).alias("c"), F.count("*").alias("n"))
            pairs = join_hot(labelled, written(centres, "centres"), ["sig"]).where((F.col("component") != F.col("c.component")) & near("c.", "", num, den))
            new = written(counted(screened(pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")))), "links")
        else:
            new = written(products(labelled, nodes, sets_of, num, den, kind), "links")
        edges = edges.unionByName(new)
        if new.take(1):
            state = components(edges)
    if state is None:
        return buckets.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return state


def products(labelled: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int, kind: str) -> DataFrame:
    """Links (a, b) across components of columns (sig, node, size, tail, component) that hold several; sets gives (node, grams) for some (node).

    In a column the rows outside its largest component are compared with all rows, block by block: what is shuffled
    grows with the blocks, not with the pairs; a column of one block is sent once. A block keeps its rows that may link with
    another; of these it is then sent the sets, and gives links that join its components, one less than there are at most.
    Without size and tail in columns whole sets count as tails."""
    if "tail" not in labelled.columns:
        labelled = labelled.join(nodes.select("node", F.col("n").alias("size"), F.col("n").alias("tail")), "node")
    parts = labelled.groupBy("sig", "component").agg(F.count("*").alias("rows"), F.sum("size").alias("grams"))
    top = F.max(F.struct("rows", "component", "grams")).alias("top")
    sums = parts.groupBy("sig").agg(F.sum("rows").alias("n"), F.sum("grams").alias("all"), top)
    sized = join_hot(labelled, written(sums, "sums"), ["sig"])
    number = lambda n, grams: F.greatest(F.ceil(n / BLOCK), F.ceil(grams / (BLOCK * MEAN))).cast("int")
    across, down = number(F.col("n"), F.col("all")), number(F.col("n") - F.col("top.rows"), F.col("all") - F.col("top.grams"))
    sized = written(sized.select("node", "sig", "component", "size", "tail", F.col("top.component").alias("main"), across.alias("across"), down.alias("down")), "sized")
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own, apart = ("node", "sig", "component", "size", "tail"), F.col("component") != F.col("main")
    # side: 0 a column's row, 1 one to compare with all, 2 both
    one = sized.where("across = 1").select(*own, F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(apart, 2).otherwise(0).alias("side"))
    many = sized.where("across > 1")
    left = many.where(apart).select(*own, block("down").alias("i"), every("across").alias("j"), F.lit(1).alias("side"))
    right = many.select(*own, every("down").alias("i"), block("across").alias("j"), F.lit(0).alias("side"))

    def pairs_of(a: pa.Table, b: pa.Table, bits: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        (n, tail), (m, behind) = ([t[c].to_numpy() for c in ("size", "tail")] for t in (a, b))
        p, q = possible(n, bits, m, others, num, den, (tail, behind))
        apart = pc.not_equal(a["component"].take(pa.array(p)), b["component"].take(pa.array(q))).to_numpy().astype(bool)
        return p[apart], q[apart]

    def sides(both: pa.Table) -> tuple[pa.Table, pa.Table]:
        return both.filter(pc.greater(both["side"], 0)), both.filter(pc.not_equal(both["side"], 1))

    def screen(both: pa.Table) -> pa.Table:
        a, b = sides(both)
        p, q = pairs_of(a, b, *(t["bits"].to_pylist() for t in (a, b)))
        some = [t.take(pa.array(np.unique(at))) for t, at in ((a, p), (b, q))]
        return pa.concat_tables(some).drop_columns(["bits"])

    def multiply(both: pa.Table) -> pa.Table:
        a, b = sides(both)
        x, y = ([np.frombuffer(g.as_buffer(), np.uint64) for g in t["grams"]] for t in (a, b))
        p, q = pairs_of(a, b, *([bitmap(g) for g in sets] for sets in (x, y)))
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        names, of = np.unique(np.concatenate([t["component"].to_numpy() for t in (a, b)]), return_inverse=True)
        group, mine, theirs = np.arange(len(names)), of[: len(x)], of[len(x) :]
        links = []
        for lo, hi in zip(*(np.searchsorted(p, np.arange(len(x)), side) for side in ("left", "right")), strict=True):
            if lo == hi:
                continue
            i, rest = int(p[lo]), q[lo:hi]
            rest = rest[group[theirs[rest]] != group[mine[i]]]
            for j in rest[product(x[i], [y[k] for k in rest.tolist()], num, den)].tolist() if len(rest) else ():
                u, v = group[mine[i]], group[theirs[j]]
                if u != v:
                    group[group == v] = u
                    links.append((i, j))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": a["node"].take(pa.array(at[:, 0])), "b": b["node"].take(pa.array(at[:, 1]))})

    keys = f"node {kind}, sig long, component {kind}, size long, tail long, i int, j int, side int"
    order = [c.split()[0] for c in keys.split(", ")]
    some = one.unionByName(left).unionByName(right).join(nodes.select("node", "bits"), "node").select(*order, "bits").groupBy("sig", "i", "j").applyInArrow(screen, keys)
    some = written(some.distinct(), "rows")
    return some.join(sets(some.select("node").distinct()), "node").groupBy("sig", "i", "j").applyInArrow(multiply, f"a {kind}, b {kind}").distinct()
