"""Reading people tables from delimited text.

Files are read as text columns (no schema inference), then cleaned with
Column expressions: null tokens, header harmonisation and numeric coercion
all run inside the scan's projection.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import normalize_gender, safe_double, safe_int

NUMERIC_CANONICAL = ("height", "weight", "BMI", "BMI_index", "age")


def read_people(spark: SparkSession, path: str | Sequence[str], sep: str = ",",
                schema: T.StructType = S.PEOPLE_SCHEMA) -> DataFrame:
    """Header CSV read as text, then typed by ``schema``.

    Columns named in ``schema`` are cast cell by cell (whole numbers through
    ``safe_int``, others through ``safe_double``, so a bad cell is null, D3);
    other columns stay text, ``gender`` trimmed and in lower case (D13).
    """
    raw = (spark.read.option("header", True).option("sep", sep)
           .option("inferSchema", False).csv(path))
    types = {f.name: f.dataType for f in schema.fields}

    def typed(c: str):
        col = F.col(f"`{c}`")
        t = types.get(c)
        if c.lower() == "gender":
            return normalize_gender(col).alias(c)
        if t is None or isinstance(t, T.StringType):
            return col.alias(c)
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return safe_int(col, t.simpleString()).alias(c)
        return safe_double(col).cast(t).alias(c)

    return raw.select(*[typed(c) for c in raw.columns])


def delimiter_of(line: str) -> str:
    """S2 rule: a tab anywhere wins, then ``;``, else ``,``."""
    if "\t" in line:
        return "\t"
    if ";" in line:
        return ";"
    return ","


#: When only files' first lines are wanted: rows of a batch, and bytes of a file that is not worth stopping for.
_HEAD_ROWS, _SMALL = 1024, 1 << 22


def _heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, line)`` of the first line of every file, in one job that reads only beginnings.

    In a session of its own, a file is one partition whatever its length.  A task
    stops after its first batch, unless the file is small: a worker that reads to
    the end serves the next task, one that stops does not.
    """
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, str(1 << 50))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_HEAD_ROWS))
    lines = own.read.option("recursiveFileLookup", True).text(list(paths))

    def first(batches):
        taken = False
        for batch in batches:
            if batch.num_rows and not taken:
                taken = True
                yield batch.slice(0, 1)
                if batch.column("size")[0].as_py() > _SMALL:
                    return

    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (
        ("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    return lines.select(*meta, F.col("value").alias("line")).mapInArrow(
        first, "file string, start bigint, size bigint, line string")


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, line)``: the first line of every file with one, in folders too.

    One job reads the beginnings.  Where a platform packs several files into one
    partition, so that some are left, a second job takes those files' first lines
    from a scan of them (the line that comes first in its task).
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
             .filter("length > 0").select(F.col("path").alias("file")))
    found = [r for r in _heads(spark, paths).collect() if r["start"] == 0]  # a row per file, as Spark's own listing
    known = {r["file"] for r in found}
    rows = [(r["file"], r["line"]) for r in found]
    left = [r["file"] for r in files.collect() if r["file"] not in known]
    schema = "file string, line string"
    out = spark.createDataFrame(rows, schema)
    if not left:
        return out
    scanned = spark.read.text(left).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("place")).filter("start = 0")
    return out.unionByName(scanned.groupBy("file").agg(F.min_by("value", "place").alias("line")))


def delimiter_col(line: Column) -> Column:
    """S2 rule on a column: a tab anywhere wins, then ``;``, else ``,``."""
    return F.when(F.contains(line, F.lit("\t")), F.lit("\t")).when(F.contains(line, F.lit(";")), F.lit(";")).otherwise(F.lit(","))


def dialects(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """S2 for any number of files: ``(file, delimiter, header)``, the header line without a byte-order mark."""
    line = F.regexp_replace("line", "^\ufeff", "")
    return first_lines(spark, paths).select("file", delimiter_col(line).alias("delimiter"), line.alias("header"))


def dialect_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, list[str]]]:
    """``(delimiter, header, files)`` of the files that share both, in order of the first file's name.

    A path with no line at all is its own group, with an empty header.
    """
    rows = dialects(spark, paths).groupBy("delimiter", "header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(((r["delimiter"], r["header"], r["files"]) for r in rows.collect()), key=lambda g: g[2])


def detect_dialect(spark: SparkSession, path: str) -> tuple[str, str]:
    """``(delimiter, header line)`` of one file, or of a folder whose files share them.

    A folder with several dialects is an error here: read it with ``read_mixed``.
    """
    groups = dialect_groups(spark, [path])
    if len(groups) > 1:
        raise ValueError(f"{path} holds {len(groups)} dialects: {[g[:2] for g in groups][:5]}")
    return groups[0][:2] if groups else (delimiter_of(""), "")


def harmonized_names(names: Sequence[str],
                     synonyms: Mapping[str, str] = S.HEADER_SYNONYMS) -> list[str | None]:
    """S6 names: lower-case, spaces to ``_``, synonyms mapped; junk -> None.

    A canonical name already taken keeps the later column under its own
    lower-cased name (D10: first one wins).  Spark resolves names without
    regard to case, so a name equal to a taken one up to case gets a
    ``_2``, ``_3``... suffix instead of becoming ambiguous.
    """
    out: list[str | None] = []
    taken: set[str] = set()
    for n in names:
        low = n.lower().replace(" ", "_")
        if low.startswith(S.JUNK_PREFIX):
            out.append(None)
            continue
        target = synonyms.get(low, low)
        if target.lower() in taken:
            target = low
        k = 2
        base = target
        while target.lower() in taken:
            target = f"{base}_{k}"
            k += 1
        taken.add(target.lower())
        out.append(target)
    return out


def harmonize(df: DataFrame, synonyms: Mapping[str, str] = S.HEADER_SYNONYMS,
              keep: Sequence[str] = S.CANONICAL_COLUMNS) -> DataFrame:
    """Harmonised headers; junk columns dropped; absent canonical columns null.

    Renames by position, because ``bmi`` and ``BMI`` are the same name to a
    case-insensitive resolver.
    """
    new = harmonized_names(df.columns, synonyms)
    renamed = df.toDF(*[n if n is not None else f"__drop{i}" for i, n in enumerate(new)])
    kept = [c for c in renamed.columns if not c.startswith("__drop")]
    out = renamed.select(*[F.col(f"`{c}`") for c in kept])
    lower_present = {c.lower() for c in kept}
    for c in keep:
        if c.lower() not in lower_present:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def null_tokens(df: DataFrame, tokens: Iterable[str] = S.NULL_TOKENS,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Cells equal to a null token become null (all string columns)."""
    toks = list(tokens)
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    target = set(cols) if cols is not None else strings
    return df.select(*[F.when(~F.col(f"`{c}`").isin(toks), F.col(f"`{c}`")).alias(c)
                       if c in target else F.col(f"`{c}`") for c in df.columns])


def collapse_pattern(sep: str) -> str:
    """Tokens of a line with runs of ``sep``: a quoted field (group 1) or a run (its first, group 2).

    A quote opens a field only at its start; inside, a doubled quote is text.  Both
    parts are possessive, so a line is read once.  Replace matches by both groups.
    """
    d = re.escape(sep)
    return f'(?:(?<![^{d}])("(?:[^"]++|"")*+"))|({d})(?:{d})*+'


def collapsed(line: str, sep: str) -> str:
    """S4 on one line: runs of ``sep`` outside quoted fields count as one."""
    return re.sub(collapse_pattern(sep), lambda m: (m[1] or "") + (m[2] or ""), line)


def _split_header(line: str, sep: str, collapse: bool) -> list[str]:
    """Header names by a CSV parse: quoted names keep their separators."""
    line = collapsed(line, sep) if collapse else line
    return [h.strip() for h in next(csv.reader([line], delimiter=sep), [])]


#: Quotes in a quoted field are doubled; lines keep their white space.
_CSV = {"escape": '"', "header": "true"}
#: A character that no text holds (a noncharacter): lines are read whole, their quotes as they are.
_WHOLE = {"sep": "\ufdd0", "quote": "", "header": "true"}


def read_delimited(spark: SparkSession, paths: Sequence[str], sep: str, header: str,
                   collapse_repeated: bool = False) -> DataFrame:
    """Read files that share one delimiter and header line as text columns.

    The first line of every file is its header and is left out by its place: a data
    line that reads the same stays.  Names come from a CSV parse of ``header``.
    ``collapse_repeated`` (S4) treats a run of delimiters outside quoted fields as
    one: lines are read whole, runs are collapsed and the line is parsed as CSV.
    """
    names = _split_header(header, sep, collapse_repeated)
    ddl = ", ".join(f"`c{i}` STRING" for i in range(len(names)))
    if not collapse_repeated:
        return spark.read.options(**_CSV, sep=sep).schema(ddl).csv(list(paths)).toDF(*names)
    lines = spark.read.options(**_WHOLE).schema("value STRING").csv(list(paths))
    fields = F.regexp_replace("value", collapse_pattern(sep), "$1$2")
    parsed = lines.select(F.from_csv(fields, ddl, {"sep": sep, "escape": _CSV["escape"]}).alias("r")).select("r.*")
    return parsed.toDF(*names)


def read_mixed(spark: SparkSession, paths: Sequence[str], collapse_repeated: bool = False,
               tokens: Iterable[str] = S.NULL_TOKENS, source_col: str | None = "source",
               numeric: Sequence[str] = NUMERIC_CANONICAL) -> DataFrame:
    """S3: read files of any dialect, harmonise each group and stack them.

    Paths are files or folders.  Every file is read by its own dialect: files are
    grouped by (delimiter, header line), and each group is one CSV scan.  Groups
    are stacked with ``unionByName(allowMissingColumns=True)``, the canonical
    numeric columns are coerced with ``safe_double``, and ``gender`` is trimmed and
    lower-cased (D13).  ``source`` holds the file name of each row when
    ``source_col`` is set.  Files without a line give no rows; if all are, the
    result is empty with the canonical columns.
    """
    frames = []
    for sep, header, files in dialect_groups(spark, paths):
        df = read_delimited(spark, files, sep, header, collapse_repeated)
        df = null_tokens(harmonize(df), tokens)
        if source_col:
            df = df.withColumn(source_col, F.element_at(F.split(F.input_file_name(), "/"), -1))
        frames.append(df)
    if not frames:
        source = [source_col] if source_col else []
        none = spark.createDataFrame([], ", ".join(f"`{c}` STRING" for c in [*S.CANONICAL_COLUMNS, *source]))
        frames = [none]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    wanted = set(numeric)

    def typed(c: str):
        col = F.col(f"`{c}`")
        if c.lower() == "gender":
            return normalize_gender(col).alias(c)
        return safe_double(col).alias(c) if c in wanted else col

    return out.select(*[typed(c) for c in out.columns])
