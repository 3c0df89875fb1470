"""Ground-truth statistics, pivots, exports, search, annotation rows and the canonical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.tokens import COLOURS, TEST_TYPES


def counts_by_type(gt: DataFrame, kind: str, file: str) -> DataFrame:
    """Rows (stat, n): tests of each type (prefix total_), all rows, files."""
    per = gt.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("total_"), F.col(kind)).alias("stat"), "n")
    both = gt.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(file).alias("files"))
    return per.unionByName(both.select(F.inline(F.array(F.struct(F.lit("rows").alias("stat"), F.col("rows").alias("n")), F.struct(F.lit("files").alias("stat"), F.col("files").alias("n"))))))


def counts_by_file(gt: DataFrame, file: str, kind: str, molecule: str, kinds: tuple[str, ...] = TEST_TYPES) -> DataFrame:
    """One row a file: molecules, and the tests of each type (0 where there are none). Conditional counts: one aggregation, no pivot pass."""
    return gt.filter(F.col(file).isNotNull()).groupBy(file).agg(F.countDistinct(molecule).alias("molecules"), *(F.count_if(F.col(kind) == k).alias(column_name(k)) for k in kinds))


def column_name(kind: str) -> str:
    return "n_" + kind.lower().replace(" ", "_")


def mean_counts(by_file: DataFrame, columns: list[str]) -> DataFrame:
    """Means over the files, zeros included."""
    return by_file.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def grouped_tests(gt: DataFrame, file: str, molecule: str, order: str) -> DataFrame:
    """Rows (file, molecule, n_tests, types): the tests of each molecule in order; rows without file or molecule are dropped."""
    types = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("test_type").alias("t")))), lambda x: x["t"])
    return gt.filter(F.col(file).isNotNull() & F.col(molecule).isNotNull()).groupBy(file, molecule).agg(F.count(F.lit(1)).alias("n_tests"), F.array_join(types, ",", "").alias("types"))


def wide(tests: DataFrame, keys: list[str], kind: str, value: str, order: str, kinds: tuple[str, ...] = TEST_TYPES) -> DataFrame:
    """One row for each key with a column for each type; the last test by order wins. One aggregation."""
    return tests.groupBy(*keys).agg(*(F.max_by(value, F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds))


def type_colours(tests: DataFrame, kind: str) -> DataFrame:
    """Rows (kind, colour): distinct types in order, the first eight coloured."""
    first = tests.filter(F.col(kind).isNotNull()).select(kind).distinct().orderBy(kind).limit(len(COLOURS))
    placed = first.agg(F.array_sort(F.collect_list(kind)).alias("k")).select(F.posexplode("k").alias("i", kind))
    return placed.select(kind, F.get(F.array(*(F.lit(c) for c in COLOURS)), F.col("i")).alias("colour"))


def label_config(colours: DataFrame, kind: str) -> DataFrame:
    """One row (config): the labelling interface as XML. Its elements and names are fixed values."""
    line = F.format_string('    <Label value="%s" background="%s"/>', F.col(kind), F.col("colour"))
    lines = colours.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("l"))
    head = '<View>\n  <RectangleLabels name="rectangles" toName="pdf" showInline="true">\n'
    tail = '\n    <Label value="Molecule" background="#AE2012"/>\n  </RectangleLabels>\n  <Image valueList="$pages" name="pdf"/>\n  <TextArea name="transcription" toName="pdf" editable="true" perRegion="true"/>\n</View>'
    return lines.select(F.concat(F.lit(head), F.col("l"), F.lit(tail)).alias("config"))


def search(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Rows of which any column matches a pattern, case ignored; nulls don't match."""
    keep = F.lit(False)
    for c in columns:
        keep |= F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){pattern}")
    return df.filter(keep)


def page_of(df: DataFrame, order: list[str | Column], page: int, size: int) -> DataFrame:
    """One page (from 1) of the ordered rows: a top-k sort and an offset, no full sort of the table."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.expr(f"CASE WHEN rows = 0 THEN 0 ELSE (rows - 1) div {size} + 1 END").alias("pages"))


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


#: Ordered patterns of the columns that hold each test. Fixed values.
COLUMN_PATTERNS = {"1H NMR": ("1h", "h1", "proton"), "13C NMR": ("13c", "c13", "carbon"), "IR": ("ir",), "MS": ("ms", "mass")}


def detect_columns(columns: list[str]) -> dict[str, str | None]:
    """The first column that fits each test's patterns, by pattern order, case ignored."""
    low = {c: c.lower() for c in columns}
    return {k: next((c for p in ps for c in columns if (p in low[c] if len(p) > 2 else low[c].split("_")[0].split(" ")[0] == p)), None) for k, ps in COLUMN_PATTERNS.items()}


def metric_columns(columns: list[str]) -> dict[str, list[str]]:
    """Precision, recall and F1 columns by test type, by prefix."""
    metrics = [c for c in columns if any(m in c for m in ("precision", "recall", "F1"))]
    return {k: [c for c in metrics if c.startswith(k)] for k in TEST_TYPES}


def annotation_rows(boxes: DataFrame, keys: list[str], label: str, text: str, start_page: str) -> DataFrame:
    """Two rows for each box, the rectangle and its text, that share an id; pages count from the segment's first."""
    shared = F.substring(F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col(label)), 256), 1, 10)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.lit("rectanglelabels").alias("type"), F.col(label).alias("value")), F.struct(F.lit(1).alias("part"), F.lit("textarea").alias("type"), F.col(text).alias("value")))
    rows = boxes.select(*keys, shared.alias("id"), (F.col("page") - F.col(start_page)).cast("bigint").alias("item_index"), "x", "y", "w", "h", F.inline(parts))
    return rows


def tasks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, task): the annotation rows of each segment as one JSON task."""
    value = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"), F.array("value").alias("labels"))
    one = F.struct(F.col("item_index").alias("item_index"), F.col("id").alias("id"), F.col("part").alias("part"), F.col("type").alias("type"), value.alias("value"))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("result"))).alias("task"))


def read_annotations(exported: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows (keys, label, text, boxes) of exported tasks: entries 2k and 2k + 1 belong together; a repeated id adds its box only."""
    entry = "array<struct<id:string,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>,text:array<string>>>>"
    each = exported.select(*keys, F.posexplode(F.from_json(column, entry)).alias("__pos", "__e"))
    pair = each.groupBy(*keys, F.expr("__pos div 2").alias("__pair")).agg(
        F.min_by("__e", "__pos").alias("__k"), F.max_by("__e", "__pos").alias("__v"), F.count(F.lit(1)).alias("__n")
    ).filter("__n = 2")
    flat = pair.select(*keys, "__pair", F.col("__k.id").alias("__id"), F.coalesce(F.col("__k.value.rectanglelabels")[0], F.col("__k.value.text")[0]).alias("label"), F.coalesce(F.col("__v.value.text")[0], F.col("__v.value.rectanglelabels")[0]).alias("text"), F.struct("__v.value.x", "__v.value.y", "__v.value.width", "__v.value.height").alias("box"))
    return flat.groupBy(*keys, "__id", "label").agg(F.min_by("text", "__pair").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("__pair", "box"))), lambda x: x["box"]).alias("boxes")).drop("__id")


def update_by_type(tests: DataFrame, changes: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """Tests with the changed texts where a change of their key and type exists; the first change in order of text counts."""
    new = changes.groupBy(*keys, kind).agg(F.min(value).alias("__new"))
    return tests.join(new, [*keys, kind], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def canonical_spectra(tests: DataFrame) -> DataFrame:
    """Tests as spectrum records: constant method and confidence, a stable id from molecule and type."""
    return tests.select(
        F.concat_ws("_", F.lit("spec"), "test_type", "molecule_id").alias("id"),
        F.col("test_type").alias("type"),
        "molecule_id",
        F.col("text_representation"),
        F.struct(F.coalesce("page_number", F.lit(0)).alias("page_number"), F.lit("text").alias("source"), F.struct(F.lit("legacy_parser").alias("algorithm"), F.lit("1.0").alias("version"), F.lit(0.8).alias("confidence")).alias("method")).alias("provenance"),
    )


def records(molecules: DataFrame, spectra: DataFrame, file: str, size: int = 1000, salts: int = 16) -> DataFrame:
    """Rows (file, part, record): nested records as JSON, molecules and spectra in order of their ids, no reactions.

    A file is one record up to size molecules, and otherwise cut into so many parts, by the molecules' ids, that a part has about that many, a
    molecule with all its spectra. spectra with a molecule that isn't in the file are in the part that their molecule's id falls in.
    """
    counts = molecules.groupBy(file).agg(F.count(F.lit(1)).alias("__n"))
    salted = counts.select(file, F.greatest(F.lit(1), F.ceil(F.col("__n") / size)).cast("int").alias("__parts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))

    def parted(df: DataFrame, molecule: str) -> DataFrame:
        own = df.withColumn("__salt", F.pmod(F.xxhash64(molecule), F.lit(salts)).cast("int"))
        with_parts = own.join(salted, [file, "__salt"], "left")
        return with_parts.withColumn("part", F.pmod(F.hash(molecule), F.coalesce("__parts", F.lit(1))).cast("bigint")).drop("__salt", "__parts")

    m = parted(molecules, "id").groupBy(file, "part").agg(F.array_sort(F.collect_list(F.struct("id", "smiles", "inchi", "label"))).alias("molecules"))
    s = parted(spectra, "molecule_id").groupBy(file, "part").agg(F.array_sort(F.collect_list(F.struct("id", "type", "molecule_id", "text_representation"))).alias("spectra"))
    both = m.join(s, [file, "part"], "full")
    return both.select(file, "part", F.to_json(F.struct(F.col(file).alias("source_filename"), F.coalesce("molecules", F.array()).alias("molecules"), F.array().cast("array<string>").alias("reactions"), F.coalesce("spectra", F.array()).alias("spectra"), F.array().cast("array<string>").alias("errors"))).alias("record"))


def graph_nodes(molecules: DataFrame, spectra: DataFrame) -> DataFrame:
    """Rows (node, kind): molecules and spectra; spectra of one type and molecule are one node."""
    m = molecules.select(F.col("molecule_id").alias("node"), F.lit("molecule").alias("kind"))
    s = spectra.select(F.concat_ws("_", F.lit("spec"), "test_type", "molecule_id").alias("node"), F.lit("spectrum").alias("kind"))
    return m.unionByName(s).distinct()


def serial_groups(names: DataFrame, column: str) -> DataFrame:
    """Rows (serial, names): file names grouped by their last but one part between underscores."""
    return names.withColumn("serial", F.try_element_at(F.split(column, "_"), F.lit(-2))).groupBy("serial").agg(F.array_join(F.array_sort(F.collect_list(column)), ";").alias("names"))


def filter_tests(tests: DataFrame, file: str | None = None, kind: str | None = None, between: tuple[float, float] | None = None, positions: Column | None = None) -> DataFrame:
    """Tests of a file, of a type, and with a peak in a range; each condition is optional."""
    out = tests
    if file is not None:
        out = out.filter(F.col("f_name") == file)
    if kind is not None:
        out = out.filter(F.col("test_type") == kind)
    if between is not None and positions is not None:
        out = out.filter(F.exists(positions, lambda p: p.between(*map(float, between))))
    return out


def apply_by_index(segments: DataFrame, changes: DataFrame, index: str, column: str) -> DataFrame:
    """Segments with the changed values of the rows of the same index; the index is explicit, never the place in a list."""
    new = changes.groupBy(index).agg(F.min(column).alias("__new"))
    return segments.join(new, index, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def register(spark, folder: str, names: list[str]) -> None:
    """The tables of a folder as temporary views."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
