"""Dirty delimited files (FIXTURES F6.1-F6.5) and the sinks."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens import schema as S
from cohortlens.sources import ingest, sinks


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimiter_rule():
    assert ingest.delimiter_of("a\tb;c,d") == "\t"
    assert ingest.delimiter_of("a;b,c") == ";"
    assert ingest.delimiter_of("a,b") == ","


def test_harmonized_names():
    got = ingest.harmonized_names(["Height CM", "Weight_kg", "BMI", "Index", "Column1", "Column 7",
                                   "bmi_index", "Gender"])
    # a later bmi_index clashes with BMI_index up to case: suffixed
    assert got == ["height", "weight", "BMI", "BMI_index", None, None, "bmi_index_2", "gender"]


def test_read_mixed_dialects_tokens_and_headers(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "a.csv"),
              "Height CM\tWeight_kg\tGender\tAge\tColumn1\n"
              "170\t70\tfemale\t30\tz\n"
              "NA\t80\tmale\tNaN\tz\n"
              " 1.5 \tabc\tnull\t1e3\tz\n")
    b = write(os.path.join(tmp_dir, "b.csv"),
              "timestamp;age;gender;height_cm;weight_kg;bmi;index;category\n"
              "2024-01-01 10:00:00;25;Male;180.00;75.00;23.15;2;Normal\n"
              "2024-01-01 11:00:00;Missing;Female;-inf;Nil;;;\n")
    df = ingest.read_mixed(spark, [a, b])
    rows = sorted(df.collect(), key=lambda r: (r.source, r.height if r.height is not None else -9e9))
    assert set(df.columns) >= set(S.CANONICAL_COLUMNS) and "column1" not in [c.lower() for c in df.columns]
    a_rows = [r for r in rows if r.source == "a.csv"]
    assert [(r.height, r.weight, r.gender, r.age) for r in a_rows] == [
        (None, 80.0, "male", None), (1.5, None, None, 1000.0), (170.0, 70.0, "female", 30.0)]
    b_rows = [r for r in rows if r.source == "b.csv"]
    assert (b_rows[0].height, b_rows[0].weight, b_rows[0].age) == (float("-inf"), None, None)
    assert (b_rows[1].BMI, b_rows[1].BMI_index) == (23.15, 2.0)


def test_collapse_repeated_delimiters(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "c.csv"), "height,,weight,age\n170,,,70,30\n180,80,,40\n")
    df = ingest.read_mixed(spark, [a], collapse_repeated=True, source_col=None)
    got = sorted((r.height, r.weight, r.age) for r in df.collect())
    assert got == [(170.0, 70.0, 30.0), (180.0, 80.0, 40.0)]


def test_read_people_types(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "p.csv"), "person_id,gender,age,height,weight\n1,female,30,170.5,x\n")
    r = ingest.read_people(spark, a).first()
    assert (r.person_id, r.gender, r.age, r.height, r.weight) == (1, "female", 30.0, 170.5, None)


def _log_rows(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(t and dt.datetime(2024, 1, t, 10), a, "Male", 180.0, 75.0, 75 / 1.8 / 1.8, 2, "Normal")
                                  for t, a in rows], S.SUBMISSION_SCHEMA)


def test_append_log_round_trip(spark, tmp_dir):
    df = _log_rows(spark, [(1, 25)])
    path = os.path.join(tmp_dir, "log")
    assert sinks.read_log(spark, path).count() == 0
    sinks.append_scored(df, path)
    sinks.append_scored(df, path)  # without ids these are two batches
    back = sinks.read_log(spark, path).collect()
    assert len(back) == 2 and back[0].bmi == 23.15 and back[0].height_cm == 180.0
    parts = [os.path.join(d, f) for d, _, files in os.walk(os.path.join(path, "parts")) for f in files if f.endswith(".csv")]
    assert len(parts) >= 2
    for part in parts:  # every part file carries the header once, as its first line
        lines = open(part, encoding="utf-8").read().splitlines()
        assert lines[0].startswith("timestamp,") and sum(ln.startswith("timestamp,") for ln in lines) == 1


def test_repeated_and_killed_batches_change_nothing(spark, tmp_dir, monkeypatch):
    from cohortlens.sources import storage

    path = os.path.join(tmp_dir, "log")
    sinks.append_scored(_log_rows(spark, [(1, 25), (None, 26)]), path, 7)
    sinks.append_scored(_log_rows(spark, [(2, 40)]), path, 8)
    sinks.append_scored(_log_rows(spark, [(1, 25), (None, 26)]), path, 7)  # a retry of the whole batch
    got = sorted((r.age, r.timestamp is None) for r in sinks.read_log(spark, path).collect())
    assert got == [(25, False), (26, True), (40, False)]  # a null timestamp stays
    with monkeypatch.context() as patch:  # a batch killed between its rows and its commit shows nothing
        patch.setattr(spark.__class__, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            storage.publish(sinks.format_log(sinks.read_log(spark, path)), path, "batch-9",
                            lambda df, folder: df.write.option("header", True).csv(folder))
    assert len(os.listdir(os.path.join(path, "parts"))) == 3 and sinks.read_log(spark, path).count() == 3
    sinks.append_scored(_log_rows(spark, [(3, 50)]), path, 9)  # and its retry counts
    assert sinks.read_log(spark, path).count() == 4


def test_a_folder_of_dialects_reads_fully(spark, tmp_dir):
    for i, sep in enumerate("\t;,\t"):
        heads = sep.join(["Height CM", "Weight_kg", "Gender"] if i < 3 else ["weight", "HEIGHT_cm"])
        rows = [sep.join(["170", str(60 + i), "Male"] if i < 3 else ["63", "171"])] * 20
        write(os.path.join(tmp_dir, f"f{i}.csv"), "\n".join([("\ufeff" if i == 1 else "") + heads, *rows]) + "\n")
    write(os.path.join(tmp_dir, "nothing.csv"), "")
    df = ingest.read_mixed(spark, [tmp_dir])
    got = sorted((r.source, r.height, r.weight, r.gender or "", r["count"]) for r in df.groupBy("source", "height", "weight", "gender").count().collect())
    assert got == [(f"f{i}.csv", 170.0, 60.0 + i, "male", 20) for i in range(3)] + [("f3.csv", 171.0, 63.0, "", 20)]
    with pytest.raises(ValueError, match="dialects"):
        ingest.detect_dialect(spark, tmp_dir)
    none = os.path.join(tmp_dir, "none")
    os.mkdir(none)
    write(os.path.join(none, "e.csv"), "")
    assert ingest.read_mixed(spark, [none]).count() == 0 and ingest.detect_dialect(spark, none) == (",", "")


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_files(spark, tmp_dir):
    counts = []
    for n in (3, 60):
        folder = os.path.join(tmp_dir, f"n{n}")
        os.mkdir(folder)
        for i in range(n):
            sep = "\t;,"[i % 3]
            write(os.path.join(folder, f"{i}.csv"), f"a{sep}b\n" + f"1{sep}2\n" * (3 if i % 10 else 5000))
        groups, jobs = _jobs(spark, f"dialects-{n}", lambda: ingest.dialect_groups(spark, [folder]))
        assert sorted((sep, len(files)) for sep, _, files in groups) == [("\t", n // 3), (",", n // 3), (";", n // 3)]
        counts.append(jobs)
    assert counts[0] == counts[1] <= 4


def test_long_files_are_not_read_to_find_their_header(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "long.csv"), "height;weight\n" + "170;60\n" * 1_500_000)
    (row,) = ingest._heads(spark, [path]).collect()
    assert (row.start, row.line) == (0, "height;weight") and row.size > ingest._SMALL
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:  # cut into many pieces, only the first one has the header
        assert ingest.detect_dialect(spark, path) == (";", "height;weight")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_left_over_are_scanned(spark, tmp_dir, monkeypatch):
    for i in range(4):
        write(os.path.join(tmp_dir, f"{i}.csv"), f"h{i};w\n" + "1;2\n" * 50)
    real = ingest._heads
    monkeypatch.setattr(ingest, "_heads", lambda *a: real(*a).filter("line = 'h2;w'"))
    got = {r.file.rsplit("/", 1)[1]: r.header for r in ingest.dialects(spark, [tmp_dir]).collect()}
    assert got == {f"{i}.csv": f"h{i};w" for i in range(4)}


def test_collapse_leaves_quoted_fields_alone(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "q.csv"),
                 '"Height, cm",,weight,,,"note"\n'
                 '170,,70,,,"a,,b"\n'
                 '"1,,71",72,"say ""x,,y"""\n'
                 'c"d,,"e,,f"\n'
                 '"Height, cm",,weight,,,"note"\n')
    ((sep, header, files),) = ingest.dialect_groups(spark, [path])
    df = ingest.read_delimited(spark, files, sep, header, collapse_repeated=True)
    assert df.columns == ["Height, cm", "weight", "note"]
    got = sorted(tuple(r) for r in df.collect())
    # a quote inside a field is text; a data line that reads like the header stays
    assert got == sorted([("170", "70", "a,,b"), ("1,,71", "72", 'say "x,,y"'), ('c"d', "e,,f", None),
                          ("Height, cm", "weight", "note")])
    plain = ingest.read_delimited(spark, files, sep, header)
    assert plain.columns == ["Height, cm", "", "weight", "", "", "note"] and plain.count() == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(","), st.sampled_from(["x", 'a"b', "1.5", '"q"', '"a,,b"', '"x""y,,"', '""'])), max_size=14))
def test_collapse_equals_a_state_machine(parts):
    line = "".join(parts)
    out, quoted, i = [], False, 0
    while i < len(line):
        ch = line[i]
        if quoted:
            if ch == '"' and line[i + 1:i + 2] == '"':
                out.append('""')
                i += 2
                continue
            quoted = ch != '"'
            out.append(ch)
        elif ch == '"' and (i == 0 or line[i - 1] == ",") and _closes(line, i):
            quoted = True
            out.append(ch)
        elif ch != "," or not out or out[-1] != "," or line[i - 1] != ",":
            out.append(ch)
        i += 1
    assert ingest.collapsed(line, ",") == "".join(out)


def _closes(line, i):
    """Whether the quoted field that opens at i ends somewhere."""
    return len(line[i + 1:].replace('""', "").split('"')) > 1


def test_big_ids_keep_every_digit(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "ids.csv"),
              "person_id,gender,age,height,weight\n9007199254740993,male,30,170,70\n12x,male,30,170,70\n")
    got = [r.person_id for r in ingest.read_people(spark, a).collect()]
    assert sorted(got, key=lambda v: (v is None, v)) == [9007199254740993, None]


def test_header_clash_up_to_case_gets_a_suffix(spark):
    got = ingest.harmonized_names(["BMI", "bmi", "Index", "BMI_index", "Height CM", "height"])
    assert got == ["BMI", "bmi_2", "BMI_index", "bmi_index_2", "height", "height_2"]
    df = spark.createDataFrame([(1.0, 2.0, 1, 2, 170.0, 171.0)],
                               "BMI double, bmi double, Index int, BMI_index int, `Height CM` double, height double")
    h = ingest.harmonize(df)
    r = h.select("BMI", "bmi_2", "BMI_index", "height", "height_2").first()
    assert tuple(r) == (1.0, 2.0, 1, 170.0, 171.0)
