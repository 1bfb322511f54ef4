"""Loading, repair and storage of source files."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions.textrepair import repair_frame, repair_text
from hearthline.operators.quality import qc_metrics
from hearthline.plans.calculations import run_aggregations, run_calculations
from hearthline.sources import csv, snapshots

HEADER = "menage_ano,score_id_ano,type_demande,score_corrige,score_calcule,date_calcul\n"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_first_row_per_score_id(spark, tmp_path):
    path = write(tmp_path / "s.csv", HEADER + "1,10,inscription,,5.0,2025-01-01\n2,20,inscription,,7.0,2025-01-01\n"
                 "3,10,correction,6.5,6.0,2025-01-02\n4,40,inscription,,8.0,2025-01-03\n")
    rows = csv.load_scores(spark, path).collect()
    assert {r["score_id_ano"]: r["menage_ano"] for r in rows} == {10: 1, 20: 2, 40: 4}
    assert {"score_final", "was_corrected"} <= set(rows[0].asDict())


def test_outliers_are_removed_before_duplicates(spark, tmp_path):
    path = write(tmp_path / "s.csv", HEADER + "1,100,a,,16.0,2025-01-01\n2,100,a,,9.0,2025-01-02\n3,200,a,,,2025-01-02\n")
    rows = csv.load_scores(spark, path).collect()
    assert [(r["menage_ano"], r["score_final"]) for r in rows] == [(2, 9.0)]
    assert csv.load_scores(spark, path, max_score=None).count() == 2


def test_rows_without_id_are_all_kept(spark, tmp_path):
    path = write(tmp_path / "s.csv", HEADER + "1,,a,,9.0,2025-01-01\n2,,a,,9.0,2025-01-02\n")
    assert csv.load_scores(spark, path).count() == 2


def test_bad_lines_and_bad_values(spark, tmp_path):
    path = write(tmp_path / "s.csv", HEADER + "1,10, radiation ,x,5.0,soon\n1,2,3,4,5,6,7\n2,20,a\n12.0,2.5,a,,7,2025-01-01\n")
    rows = csv.load_csv(spark, path, csv.SCORE_TYPES).orderBy("menage_ano").collect()
    assert [(r["menage_ano"], r["score_id_ano"]) for r in rows] == [(1, 10), (2, 20), (12, None)]
    assert rows[0]["score_corrige"] is None and rows[0]["date_calcul"] is None
    assert rows[1]["score_calcule"] is None


def test_corrected_flag(spark):
    frame = spark.createDataFrame(
        [(1, " a ", 5.0, 5.0), (2, "a", 5.0, 6.0), (3, "a", 5.0, None), (4, "a", None, 6.0)],
        "id long, type_demande string, score_corrige double, score_calcule double",
    )
    rows = csv.final_score(frame).orderBy("id").collect()
    assert [r["was_corrected"] for r in rows] == [False, True, True, False]
    assert [r["score_final"] for r in rows] == [5.0, 5.0, 5.0, 6.0]
    assert rows[0]["type_demande"] == "a"


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_households_in_two_encodings(spark, tmp_path, encoding):
    text = ("menage_ano,milieu,region,genre_cm,taille_menage\n1, uRBAIN ,Fès-Meknès,MASCULIN,4\n"
            "1,rural,Autre,F,3\n2,rural,Drâa-Tafilalet,féminin,x\n3,,,2,\n")
    rows = csv.load_households(spark, write(tmp_path / "m.csv", text, encoding)).orderBy("menage_ano").collect()
    assert [(r["milieu"], r["region"], r["genre_cm"], r["taille_menage"]) for r in rows] == [
        ("Urbain", "Fès-Meknès", "Homme", 4), ("Rural", "Drâa-Tafilalet", "Femme", None), (None, None, "Femme", None),
    ]


def test_text_repair_values(spark):
    cases = {
        "FÃ¨s-MeknÃ¨s": "Fès-Meknès",
        "Fès": "Fès",
        "F\x82s-Mekn\x8as": "Fès-Meknès",
        "x\x80": "x€",
        "a\x81\x80": "a\x81\x80",
        "â‚¬ déjà": "â‚¬ déjà",
        "Feminin": "Féminin",
        "GuelmimOued Noun": "Guelmim-Oued Noun",
        "": "",
        None: None,
    }
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, s string")
    found = [r[1] for r in frame.select("i", repair_text(F.col("s"))).orderBy("i").collect()]
    assert found == list(cases.values())


def test_only_damaged_columns_are_repaired(spark):
    frame = spark.createDataFrame([("Feminin", "Ã©"), ("x", "y")], "a string, b string")
    assert [tuple(r) for r in repair_frame(frame).collect()] == [("Feminin", "é"), ("x", "y")]
    forced = repair_frame(frame, columns=["a"], extra={"x": "z"}).collect()
    assert [tuple(r) for r in forced] == [("Féminin", "Ã©"), ("z", "y")]


def test_programme_lists(spark, tmp_path):
    a = write(tmp_path / "a.csv", "menage_ano\n1\n1\n2\n")
    frame = csv.load_all_programmes(spark, {"amot": a, "asd": a})
    assert sorted(map(tuple, frame.collect())) == [(1, "AMOT"), (1, "ASD"), (2, "AMOT"), (2, "ASD")]
    assert csv.load_all_programmes(spark, {}).columns == ["menage_ano", "programme"]
    table = write(tmp_path / "p.csv", "menage_ano,programme\n1,amot\n2,asd\n2,asd\n")
    assert sorted(map(tuple, csv.load_programme_table(spark, table).collect())) == [(1, "AMOT"), (2, "ASD")]


def test_latest_version_over_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", HEADER + "1,10,a,,5.0,2025-01-02\n1,11,a,,5.0,2025-01-02\n")
    b = write(tmp_path / "b.csv", HEADER + "1,10,a,,6.0,2025-01-01\n1,11,a,,7.0,2025-02-01\n")
    rows = csv.merge_score_files(spark, [a, b], str(tmp_path)).orderBy("score_id_ano").collect()
    assert [r["score_final"] for r in rows] == [5.0, 7.0]


def test_raw_lines(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    write(folder / "a.csv", "h\n1\n2\n")
    write(folder / "b.csv", "h\n3\n")
    assert csv.raw_row_count(spark, str(folder)).collect()[0][0] == 3


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    frame, empty = spark.range(3), spark.range(0)
    assert set(snapshots.save_frames({"a": frame, "e": empty}, folder, skip_empty=True)) == {"a"}
    snapshots.save_frames({"a": frame}, folder)
    with pytest.raises(Exception, match="exists"):
        snapshots.save_frames({"a": frame}, folder, overwrite=False)
    (tmp_path / "s" / "broken.parquet").write_text("no parquet")
    assert list(snapshots.load_snapshots(spark, folder)) == ["a"]
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshots(spark, folder, ["absent"])
    with pytest.raises(ValueError):
        snapshots.load_snapshots(spark, folder + "x")


def test_calculations_and_aggregations(spark, tmp_path):
    base = {"a": spark.range(4)}
    frames = run_calculations(base, {"b": lambda f: f["a"].where("id > 1"), "c": lambda f: f["b"].limit(1)})
    assert frames["b"].count() == 2 and frames["c"].count() == 1 and list(base) == ["a"]
    with pytest.raises(TypeError):
        run_calculations(base, {"x": lambda f: 1})
    out = str(tmp_path / "k")
    done = run_aggregations(spark, {"n": "SELECT count(*) AS n FROM {a}", "m": lambda f: f["a"]}, frames=base, output=out)
    assert done["n"].collect()[0][0] == 4
    assert spark.read.parquet(f"{out}/_catalog").collect()[0]["frame_names"] == ["a"]
    with pytest.raises(ValueError):
        run_aggregations(spark, {})
    with pytest.raises(TypeError):
        run_aggregations(spark, {"x": 3}, frames=base)


def test_quality_metrics_with_empty_inputs(spark):
    raw = spark.createDataFrame([], "menage_ano long, score_final double")
    homes = spark.createDataFrame([], "menage_ano long")
    events = spark.createDataFrame([], "menage_ano long, programme string")
    rows = qc_metrics(raw, raw, homes, homes, events).collect()
    assert len(rows) == 7 and all(r["before"] == 0 and r["pct_dropped"] == 0.0 for r in rows)


def test_quotes_and_broken_lines(spark, tmp_path):
    path = write(tmp_path / "b.csv", 'menage_ano,partner_id,motif,date_insert,actif\n'
                 '1,a,"dit ""oui"", puis non",2025-01-01,True\n2,b,"""entre"" guillemets",2025-01-02,False\n'
                 '3,c,"une ligne\net la suite",2025-01-03,True\n4,d,5" de long,2025-01-04,True\n5,e,x,2025-01-05,True,trop\n')
    rows = csv.load_beneficiaries(spark, path).orderBy("menage_ano").collect()
    assert [(r["menage_ano"], r["motif"]) for r in rows] == [
        (1, 'dit "oui", puis non'), (2, '"entre" guillemets'), (4, '5" de long')]
    assert csv.rejected_lines(spark, path).count() == 3
    whole = csv.load_csv(spark, path, csv.BENEFICIARY_TYPES, multi_line=True).orderBy("menage_ano").collect()
    assert [r["motif"] for r in whole][2] == "une ligne\net la suite" and len(whole) == 4


def test_files_with_their_own_headers(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "a.csv", "menage_ano,score_id_ano,score_calcule\n1,10,5.0\n")
    write(folder / "b.csv", "score_id_ano,menage_ano,type_demande\n20,2,radiation\n")
    rows = csv.load_csv(spark, str(folder), csv.SCORE_TYPES).orderBy("menage_ano").collect()
    assert [(r["menage_ano"], r["score_id_ano"], r["score_calcule"], r["type_demande"]) for r in rows] == [
        (1, 10, 5.0, None), (2, 20, None, "radiation")]


def test_characters_missing_words_and_dates(spark, tmp_path):
    utf8 = "menage_ano,partner_id,motif,date_insert,actif\n1,a,فاس cœur,01/02/2025,True\n2,N/A,NULL,13/02/2025 10:30,None\n".encode()
    latin = "3,c,déjà œuvre,2025-01-01T10:00:00+02:00,nan\n4,d,Nantes,2025-01-01 10:00:00,True\n".encode("cp1252")
    (tmp_path / "u.csv").write_bytes(utf8 + latin)
    rows = csv.load_beneficiaries(spark, str(tmp_path / "u.csv")).orderBy("menage_ano").collect()
    assert [(r["partner_id"], r["motif"], str(r["date_insert"]), r["actif"]) for r in rows] == [
        ("A", "فاس cœur", "2025-01-02 00:00:00", True), (None, None, "2025-02-13 10:30:00", None),
        ("C", "déjà œuvre", "2025-01-01 08:00:00", None), ("D", "Nantes", "2025-01-01 10:00:00", True)]


def test_line_breaks_in_every_loader(spark, tmp_path):
    scores = write(tmp_path / "s.csv", HEADER + '1,10,"ins\ncription",,5.0,2025-01-01\n2,20,a,,6.0,2025-01-01\n')
    assert csv.load_scores(spark, scores).count() == 1
    assert csv.load_scores(spark, scores, multi_line=True).count() == 2
    assert csv.load_raw_scores(spark, scores, multi_line=True).count() == 2
    assert csv.merge_score_files(spark, [scores], str(tmp_path), multi_line=True).count() == 2
    homes = write(tmp_path / "m.csv", 'menage_ano,region,milieu\n1,"Fès\r\nMeknès",rural\n')
    assert csv.load_households(spark, homes, multi_line=True).collect()[0]["region"] == "Fès\r\nMeknès"
    lists = write(tmp_path / "p.csv", 'menage_ano,programme,note\n1,amot,"a\nb"\n2,asd,c\n')
    assert csv.load_programme_table(spark, lists, multi_line=True).count() == 2
    assert csv.load_all_programmes(spark, {"amot": lists}, multi_line=True).count() == 2
    people = write(tmp_path / "b.csv", 'menage_ano,partner_id,motif\n1,a,"une\nligne"\n2,b,c\n')
    rows = csv.load_beneficiaries(spark, people, multi_line=True).orderBy("menage_ano").collect()
    assert [r["motif"] for r in rows] == ["une\nligne", "c"]


def test_unclosed_quote_is_rejected_and_not_swallowed(spark, tmp_path):
    path = write(tmp_path / "b.csv", 'menage_ano,motif,actif\n1,"a\nb",True\n2,"jamais fermé,True\n3,c,True\n')
    rows = csv.load_csv(spark, path, {"menage_ano": "long"}, multi_line=True).collect()
    lost = [r["line"] for r in csv.rejected_lines(spark, path, multi_line=True).collect()]
    assert [r["menage_ano"] for r in rows] == [1]
    assert len(lost) == 1 and "jamais fermé" in lost[0] and "3,c,True" in lost[0]


def test_stray_quotes_in_front_of_empty_fields(spark, tmp_path):
    """Unquoted fields may hold quotes anywhere; only a line that leaves a field open is a half."""
    head = "menage_ano,partner_id,motif,date_insert,actif\n"
    good = '1,asd,dit "oui",2025-01-01,\n2,a,"x",,\n3,b,fin",,\n5,asd,fin "x",,\n6,"",""" """,,\n7,c,"a"b",,\n8,d\n'
    path = write(tmp_path / "a.csv", head + good)
    rows = csv.load_beneficiaries(spark, path).orderBy("menage_ano").collect()
    assert [r["menage_ano"] for r in rows] == [1, 2, 3, 5, 6, 7, 8]
    assert [r["motif"] for r in rows][:5] == ['dit "oui"', "x", 'fin"', 'fin "x"', '" "']
    assert csv.rejected_lines(spark, path).isEmpty()
    # The same lines around real halves: a field over two, three and four lines, and one never closed.
    halves = '20,a,"une\nligne",,\n21,a,"et\n\ndeux",,\n22,a,"x\n23,y,z\n24,""u""\nv",,True\n'
    path = write(tmp_path / "b.csv", head + good + halves + good + '30,a,"jamais,,\n31,a,b,,\n32,d\n')
    rows = csv.load_beneficiaries(spark, path).collect()
    assert sorted(r["menage_ano"] for r in rows) == sorted([1, 2, 3, 5, 6, 7, 8] * 2 + [31, 32])
    lost = [r["line"] for r in csv.rejected_lines(spark, path).collect()]
    assert sorted(lost) == sorted(['20,a,"une', 'ligne",,', '21,a,"et', 'deux",,', '22,a,"x', "23,y,z", '24,""u""', 'v",,True', '30,a,"jamais,,'])


def test_quotes_open_over_block_borders(spark, tmp_path):
    """The state is carried from block to block of a split file."""
    lines = []
    for i in range(4000):
        lines.append(f'{i},a,"x{i}\nsuite {i}",,True' if i % 7 == 0 else f'{i},a,"y",,True' if i % 2 else f"{i},a,z,,True")
    path = write(tmp_path / "big.csv", "menage_ano,partner_id,motif,date_insert,actif\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = [r[0] for r in csv.load_beneficiaries(spark, path).select("menage_ano").collect()]
        lost = csv.rejected_lines(spark, path).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found) == [i for i in range(4000) if i % 7]
    assert lost == 2 * len(range(0, 4000, 7))


def test_many_files_take_a_constant_number_of_jobs(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(200):
        head = "menage_ano,motif\n" if i % 2 else "motif;x,menage_ano\n"
        write(folder / f"f {i}.csv", head + (f"{i},a\n" if i % 2 else f"b,{i}\n"))
    (folder / "empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-files", "")
    try:
        frame = csv.load_csv(spark, str(folder), {"menage_ano": "long"})
        found = frame.collect()
        jobs = len(tracker.getJobIdsForGroup("many-files"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert sorted(r["menage_ano"] for r in found) == list(range(200))
    assert jobs <= 12


def test_header_names(spark, tmp_path):
    names = csv._header_names('﻿a,"b, c",a,,é\r\n'.encode(), ",")
    assert names == ("a", "b, c", "a.1", "Unnamed: 3", "é")
    assert csv._header_names("région,x".encode("cp1252"), ",") == ("région", "x")


def test_helper_columns_do_not_hide_those_of_the_user(spark):
    from hearthline.operators.dedup import keep_one, keep_one_keep_null

    frame = spark.createDataFrame([(1, "a", "p", "q"), (1, "b", "p", "q"), (None, "c", "p", "q")], "id int, v string, _pick string, _alone string")
    for kept in (keep_one(frame, ["id"], [F.col("v")]), keep_one_keep_null(frame, "id", [F.col("v")])):
        assert kept.columns == frame.columns
        assert sorted(r["v"] for r in kept.collect()) == ["a", "c"]
        assert {(r["_pick"], r["_alone"]) for r in kept.collect()} == {("p", "q")}
