"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long lines cut behind a sentence end; the
sketch holds the set of their 64-bit digests. It has three parts of ``side``
cells; a digest enters one cell of each part, where a cell keeps a count, the
XOR of its digests and the XOR of their checksums. Subtracting two sketches
cell by cell leaves the digests in which the texts differ; peeling takes out
cells that hold a single digest (count 1 or -1 and a right checksum) until
nothing is left. When peeling gets stuck, both texts are sketched again with
more cells and other hashes, sized from the two counts, then twice and four
times that. If even that fails (never seen; the chance falls with the cube of
the size), the sets are subtracted directly.

Everything is built from SQL functions over arrays; no Python runs in tasks.

Defined cases: null text is empty, an empty text has a sketch of zeros and is
like another empty text by 1; repeated paragraphs count once; repeated ids
are ordered by a hash of their text; null ids come last; an only document's
next one is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 12  # cells of each of the three parts of the published sketch
ROUNDS = 16  # peeling rounds; each takes out all single digests at once
PARAGRAPH = r"[^\n]{100,}?[.!?](?=\s|$)|[^\n]+"  # a line, cut at the first sentence end behind 100 characters


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a non-null text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _places(key: str, side: str, attempt: int) -> str:
    return "array(" + ", ".join(f"pmod(xxhash64({key}, {10 * attempt + j}), {side})" for j in range(3)) + ")"


def _per_cell(entries: str, side: str, cell: str) -> str:
    """SQL for an array with one entry per cell, parts one after another.

    ``cell`` is SQL over v (the entries near the cell), j (part), g (block), w
    (block width). Blocks of about the root of a part's size keep a text of u
    paragraphs at about u times that root instead of u times all cells."""
    return (f"transform(array(named_struct('e', {entries}, 'w', cast(ceil(sqrt({side})) as bigint))), q -> flatten(transform(sequence(0, 2), j -> "
            f"flatten(transform(sequence(0L, ({side} - 1) div q.w), g -> transform(array(filter(q.e, x -> x.at[j] div q.w = g)), v -> {cell})[0])))))[0]")


def _cells(units: str, side: str, attempt: int) -> str:
    """SQL for the sketch of an array of digests."""
    placed = f"transform({units}, d -> named_struct('d', d, 'c', hash(d, 7), 'at', {_places('d', side, attempt)}))"
    cell = (f"transform(sequence(g * q.w, least({side}, (g + 1) * q.w) - 1), i -> aggregate(filter(v, x -> x.at[j] = i), "
            "named_struct('n', 0, 'k', 0L, 'c', 0), (a, x) -> named_struct('n', a.n + 1, 'k', a.k ^ x.d, 'c', a.c ^ x.c)))")
    return _per_cell(placed, side, cell)


def _minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _peel(cells: str, side: str, attempt: int) -> str:
    """SQL for (cells left, digests found with their sign)."""
    single = ("array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and x.c = hash(x.k, 7)), "
              f"x -> named_struct('n', x.n, 'd', x.k, 'c', x.c, 'at', {_places('x.k', side, attempt)})))")
    block = f"slice(s.cells, cast(j * {side} + g * q.w + 1 as int), cast(least({side} - g * q.w, q.w) as int))"
    cell = (f"if(size(v) = 0, {block}, transform({block}, (x, i) -> aggregate(filter(v, y -> y.at[j] = g * q.w + i), x, "
            "(a, y) -> named_struct('n', a.n - y.n, 'k', a.k ^ y.d, 'c', a.c ^ y.c))))")
    step = (f"if(s.go, transform(array({single}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), "
            f"named_struct('cells', {_per_cell('p', side, cell)}, "
            "'found', concat(s.found, transform(p, y -> named_struct('n', y.n, 'd', y.d))), 'go', true)))[0], s)")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', "
            f"cast(array() as array<struct<n:int,d:bigint>>), 'go', true), (s, r) -> {step})")


def _answer(peeled: str) -> str:
    """SQL for the digests found, null when peeling got stuck."""
    return f"transform(array({peeled}), s -> if(forall(s.cells, x -> x.n = 0 and x.k = 0 and x.c = 0), s.found, null))[0]"


def sketch(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Add <prefix>_units, <prefix>_cells (the published sketch)."""
    units, cells = f"{prefix}_units", f"{prefix}_cells"
    return df.withColumn(units, digests(F.col(text_col))).withColumn(cells, F.expr(_cells(units, f"{SIDE}L", 0)))


def fingerprint(cells: Column) -> Column:
    """The sketch as text: count.digests.checksums in hex per cell."""
    return F.concat_ws(",", F.transform(cells, lambda x: F.when(x["n"] == 0, F.lit("0")).otherwise(
        F.concat_ws(".", F.lower(F.hex(x["n"])), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"]))))))


def differences(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: the digests (n = 1: only in a, n = -1: only in b) by which
    the texts sketched under prefixes ``a`` and ``b`` differ."""
    ua, ub = f"{a}_units", f"{b}_units"
    tries = [_answer(_peel(_minus(f"{a}_cells", f"{b}_cells"), f"{SIDE}L", 0))]
    for k in range(1, 4):
        side = f"(({1 << (k - 1)} * (size({ua}) + size({ub})) * 6) div 10 + {SIDE})"  # bigint, 1.8 cells a digest at first
        tries.append(_answer(_peel(_minus(_cells(ua, side, k), _cells(ub, side, k)), side, k)))
    exact = (f"concat(transform(array_except({ua}, {ub}), d -> named_struct('n', 1, 'd', d)), "
             f"transform(array_except({ub}, {ua}), d -> named_struct('n', -1, 'd', d)))")
    return df.withColumn(out, F.expr(f"coalesce({', '.join(tries)}, {exact})"))


def likeness(a: str, b: str, diff: str) -> Column:
    """Jaccard likeness of two digest sets from their sizes and differences; 1 for two empty ones."""
    total, d = F.size(f"{a}_units") + F.size(f"{b}_units"), F.size(diff)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d).cast("double"))


def with_next(docs: DataFrame, rows: int = 2000, most: int = 4096) -> DataFrame:
    """Rows (doc_id, text) with ``next_text``: the text of the next document in
    falling order of the id, of the first for the last.

    Ids are cut into ranges of about ``rows`` rows (at most ``most`` ranges;
    beyond that ranges grow and their sort spills), so texts are shuffled once
    and every range is one window group. A range's last row takes the first
    text of the next range that has rows."""
    n = docs.count()
    parts = max(1, min(most, -(-n // rows)))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null").approxQuantile(
        "d", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    edges = F.array(*[F.lit(float(b)) for b in bounds or [float("-inf")]])
    place = F.size(F.filter(edges, lambda e: e > F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
    rows_ = docs.withColumn("b", place).withColumn("o", F.xxhash64("text"))
    firsts = rows_.groupBy("b").agg(F.max_by("text", F.struct("doc_id", "o")).alias("head"))
    ranges = firsts.select("b").withColumn("after", F.coalesce(F.lead("b").over(Window.orderBy("b")), F.min("b").over(
        Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))  # <= most rows
    heads = ranges.join(firsts.withColumnsRenamed({"b": "after"}), "after").select("b", "head")
    inside = F.lead("text").over(Window.partitionBy("b").orderBy(F.struct("doc_id", "o").desc()))
    return (rows_.withColumn("inside", inside).join(heads, "b")
            .select("doc_id", "text", F.coalesce("inside", "head").alias("next_text")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and the digests by which the text differs from its
    edited version (``edits``)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = with_next(own).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    s = sketch(sketch(sketch(rows, "text", "own"), "edited", "edit"), "next_text", "next")
    s = differences(differences(s, "own", "edit", "edits"), "own", "next", "apart")
    return s.select(F.col("doc_id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    fingerprint(F.col("own_cells")).alias("fingerprint"), fingerprint(F.col("edit_cells")).alias("edited_fingerprint"),
                    likeness("own", "edit", "edits").alias("near_edited"), likeness("own", "next", "apart").alias("near_next"), "edits")
