"""Lookups, corrections, blends, validators, settings and sinks: what they refuse and what they keep."""

import itertools

import pytest
from pyspark.errors import PySparkException

from tests.conftest import SF
from tributary import __main__ as command
from tributary.config import Settings
from tributary.functions import normalize as N
from tributary.functions import translit
from tributary.operators import decide as D
from tributary.operators import evaluate as E
from tributary.operators import features as X
from tributary.operators import models as M
from tributary.operators import profile as P
from tributary.plans import catalogue
from tributary.sources import tsv


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "s1_id long, cand_id long, p double")


def test_lookup_fails_on_unknown_and_repeated_keys(spark):
    dimension = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k long, v string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert sorted(D.lookup(keys(1, 2, 2), dimension, "k", "v").collect()) == [(1, "a"), (2, "b"), (2, "b")]
    for wrong in (9, 3, None):
        with pytest.raises(PySparkException):
            D.lookup(keys(1, wrong), dimension, "k", "v").collect()


def test_corrections_are_refused_or_keep_order(spark):
    selected = spark.createDataFrame([(1, 10, 5), (1, 11, 2), (2, 20, 0)], "s1_id long, cand_id long, at long")
    log = lambda *rows: spark.createDataFrame(rows, "seq long, s1_id long, cand_id long, action string")
    out = D.apply_corrections(selected, log((1, 1, 10, "remove"), (2, 1, 30, "add"), (3, 2, 10, "add"), (4, 1, 29, "add")))
    lists = D.id_lists(selected.select("s1_id").distinct(), out.select("s1_id", "cand_id", "at").withColumnRenamed("at", "place"), order=catalogue.record_queries.F.col("place"))
    assert {r.s1_id: r.ids for r in lists.collect()} == {1: "11,30,29", 2: "20,10"}
    for wrong in ((1, 2, 10, "remove"), (1, 2, 11, "add")):
        with pytest.raises(ValueError, match="correction 1"):
            D.apply_corrections(selected, log(wrong))


def test_blend_and_attach_refuse_missing_scores(spark):
    a, b = pairs(spark, (1, 1, 0.2), (1, 2, 0.4)), pairs(spark, (1, 1, 0.4), (1, 2, 0.4))
    assert sorted(r.p for r in D.blend(a, b).collect()) == pytest.approx([0.3, 0.4])
    for x, y in ((a, b.limit(1)), (a.limit(1), b)):
        with pytest.raises(PySparkException):
            D.blend(x, y).collect()
    many = pairs(spark, *((i, i, 0.5) for i in range(2000)))
    assert X.attach_score(many, many.where("s1_id > 0"), "ce", 0.999).where("ce IS NULL").count() == 1
    with pytest.raises(PySparkException):
        X.attach_score(many, many.where("s1_id > 2"), "ce", 0.999).collect()


def test_policy_by_score_table_needs_every_group(spark):
    entities = spark.createDataFrame([(1, "x"), (2, "y")], "s1_id long, grp string")
    a, b = pairs(spark, (1, 1, 0.6), (2, 2, 0.9)), pairs(spark, (1, 1, 0.1), (2, 2, 0.3))
    got = D.select_by_scores({"a": a, "b": b}, {"x": ("a", 0.5), "y": ("b", 0.2)}, entities, "grp").collect()
    assert sorted((r.s1_id, r.cand_id, r.p) for r in got) == [(1, 1, 0.6), (2, 2, 0.3)]
    with pytest.raises(ValueError, match="y"):
        D.select_by_scores({"a": a}, {"x": ("a", 0.5)}, entities, "grp")


FAULTS = {
    "wrong header": "id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1\n",
    "lines without a tab": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1\nS1-1,S2-1\n",
    "duplicate rows": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1\nS1-2\t\n",
    "duplicate ids in a list": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1,S2-1\n",
    "ids of source 1": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS1-1\n",
    "ids with a wrong prefix": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tX\n",
    "unknown ids": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS3-9\n",
    "missing entities": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n",
    "extra entities": "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1\nS1-3\t\n",
    "empty file": "",
    None: " Source1_Entity_ID \tmatched_entity_ids\n\nS1-1\t\nS1-2\tS2-1,S3-1\n",
}


@pytest.mark.parametrize("rule", FAULTS, ids=str)
def test_validator_finds_each_fault(spark, tmp_path, rule):
    (tmp_path / "m.tsv").write_text(FAULTS[rule])
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "cand_id string")
    found = E.validate_answer(spark, str(tmp_path / "m.tsv"), required, known)
    errors = {r.rule for r in found.where("severity = 'error'").collect()}
    assert errors == ({rule} if rule not in ("wrong header", "empty file") else errors | {rule}) - {None}
    assert E.exit_code(found) == int(rule is not None)
    assert {r.rule for r in found.where("severity = 'warning'").collect()} == {"no candidate file"}


def test_matches_outside_candidates_only_warn(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\n")
    spark.createDataFrame([("S1-1",)], "s1_id string").write.parquet(str(tmp_path / "required"))
    found = E.validate_answer(spark, str(tmp_path / "m.tsv"), spark.read.parquet(str(tmp_path / "required")), None, str(tmp_path / "c.tsv"))
    assert {(r.rule, r.severity) for r in found.where("n > 0").collect()} == {("ids not checked", "warning"), ("matches that are no candidates", "warning")}
    assert command.main(["validate", str(tmp_path / "m.tsv"), "--required", str(tmp_path / "required")], spark) == 0
    (tmp_path / "m.tsv").write_text("nothing\n")
    assert command.main(["validate", str(tmp_path / "m.tsv"), "--required", str(tmp_path / "required")], spark) == 1


def test_command_runs_a_query(spark, tmp_path):
    assert command.main(["run", "role_split", "--data", SF, "--out", str(tmp_path)], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/role_split").count() == catalogue.QUERIES["role_split"](spark, SF).count()
    assert command.main(["list"]) == 0


def test_settings():
    s = Settings.from_environment({"TRIBUTARY_DATA": "s3a://x/y/", "TRIBUTARY_PARTITIONS": "7"})
    assert (s.path("data", "a", "b"), s.partitions, s.output) == ("s3a://x/y/a/b", 7, "output")


def test_lists_in_entity_order_in_one_file(spark, tmp_path):
    rows = [(f"S1-{i}", "" if i % 3 else f"S2-{i}", i) for i in (5, 2, 9, 1, 7)]
    tsv.write_id_lists(spark.createDataFrame(rows, "s1_id string, ids string, place int"), str(tmp_path / "out"), order="place", one_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\n" + "".join(f"{s}\t{ids}\n" for s, ids, _ in sorted(rows, key=lambda r: r[2]))


def test_names_of_models_and_feature_groups(spark):
    assert M.model_tag("v1") == "v1" and M.model_tag("v1", True, "l12", True, True, True) == "v1cel12xdg"
    assert len(M.feature_set([])) == 15 and M.feature_set(["ce"])[-3:] == ["ce", "ce_rank", "ce_gap"]
    assert len(M.feature_set(["tw"])) == 15 + 22 and all(c.startswith("tw_") for c in M.feature_set(["tw"])[15:])
    with pytest.raises(ValueError):
        M.feature_set(["zz"])
    got = M.attach(pairs(spark, (1, 1, 0.5), (1, 2, 0.5)), spark.createDataFrame([(1, 1, 3)], "s1_id long, cand_id long, a int")).collect()
    assert {(r.cand_id, r.tw_a) for r in got} == {(1, 3), (2, None)}


def test_contained_items_of_any_length(spark):
    texts = ["a b c d e f g", "xa b cy", "b", "", None, "one two three four five six seven eight", "pre one two three four five sixth"]
    items = ["a b", "b", "a b c", "b c d", "one two three four five six", "a b c d e", "", "zzz", "e two thr", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    want = {(i, k) for (i, x), (k, t) in itertools.product(enumerate(items), enumerate(texts)) if x is not None and t is not None and x in t}
    assert {(r.item_id, r.doc_id) for r in P.contained(docs, df).collect()} == want
    assert P.contained(docs, df.limit(0)).count() == 0


def spelt(word):
    """Syllable by syllable, with the tables looked up one letter at a time."""
    out, i, letters = "", 0, [c for c in word if c not in translit.JOINERS]
    while i < len(letters):
        c = ord(letters[i])
        sister = 0x0900 + c % 128 if 0x0900 <= c < 0x0D80 else None
        i += 1
        if c in translit.ALONE:
            out += translit.ALONE[c]
        elif sister in translit.CONSONANTS:
            consonant = translit.CONSONANTS[sister]
            if i < len(letters) and ord(letters[i]) % 128 == 0x3C and 0x0900 <= ord(letters[i]) < 0x0D80:
                consonant, i = translit.DOTTED.get(consonant, consonant), i + 1
            out += consonant
            follow = 0x0900 + ord(letters[i]) % 128 if i < len(letters) and 0x0900 <= ord(letters[i]) < 0x0D80 and ord(letters[i]) not in translit.ALONE else None
            if follow in translit.SIGNS or follow == translit.VIRAMA:
                out += translit.SIGNS.get(follow, "")
                i += 1
            elif i < len(letters) or c // 128 * 128 not in translit.SILENT_END:
                out += "a"
        elif sister is None:
            out += letters[i - 1]
        else:
            out += (translit.VOWELS | translit.NASALS | translit.DIGITS | translit.SIGNS).get(sister, "")
    return "".join(c for c, _ in ((k, None) for k, g in itertools.groupby(out) for k in ([k] if k in "aeiou" else list(g))))


WORDS = {"नमस्ते": "namaste", "ગુજરાતી": "gujarati", "தமிழ்": "tamizh", "తెలుగు": "telugu", "ಕನ್ನಡ": "kannada", "ଭାଷା": "bhasha", "मार्केटिंग": "marketing"}


def test_nine_scripts(spark):
    for native, latin in WORDS.items():
        assert translit.word(native) == spelt(native) == latin
    got = {r.id: r for r in catalogue.QUERIES["translit_words"](spark, SF).collect()}
    assert len(got) == 25
    for r in got.values():
        assert not translit.is_native(r.latin) and r.latin.split()[0] == (spelt(r.raw.split()[0]) if translit.is_native(r.raw) else r.latin.split()[0])
    assert " sarl " in f" {got[9].undotted} " and "ｗ" not in got[10].latin


def test_dominant_script(spark):
    rows = [("abc def",), ("कखग abc कखगघ",), ("తెలుగు",), ("123 !",), ("",)]
    df = spark.createDataFrame(rows, "t string").select("t", N.dominant_script(catalogue.record_queries.F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["latin", "native", "native", "none", "none"]
