"""Small scenarios for the region operators, and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from regionary.functions import reading as R
from regionary.functions import text as T
from regionary.operators import fit, gates, graph, jobs, layout, requests, validation
from regionary.sources import files, vectors

BOX = "box struct<x0:double,y0:double,x1:double,y1:double>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def region(i, text, y, kind="paragraph", x=40.0, size=10.0, page=0):
    return ("j", page, i, f"{page}/{i}", kind, text, (x, y, x + 200.0, y + 10.0), size, 1)


REGION = f"job string, page int, idx int, id string, kind string, text string, {BOX}, size double, n_lines int"


@pytest.mark.parametrize(
    ("a", "b", "linked"),
    [
        ("the cabinet must be placed so that", "air can pass on both sides", True),
        ("the cabinet must be placed here.", "air can pass on both sides", False),
        ("5.1.1 Safety requirements for the room", "air can pass on both sides", False),
        ("packing list of the whole set....... 9", "air can pass on both sides", False),
        ("the cabinet must be placed so that", "Table 3 of all parts", False),
        ("the cabinet must be placed so that", "Website: none at all", False),
        ("best regards,", "air can pass on both sides", False),
    ],
)
def test_flow_links(spark, a, b, linked):
    df = frame(spark, [region(0, a, 0.0), region(1, b, 12.0)], REGION)
    got = graph.page_links(df).collect()
    assert [(r["from"], r["to"]) for r in got] == ([("0/0", "0/1")] if linked else [])
    if linked:
        assert got[0]["score"] == round(1 - 0.3 * 2 / 10, 3)


def test_wide_gap_breaks_and_labels_stack(spark):
    df = frame(spark, [region(0, "the cabinet must be placed so that", 0.0), region(1, "air can pass", 30.0), region(2, "Dry", 60.0, "diagram_label"), region(3, "contact", 70.5, "diagram_label")], REGION)
    assert [(r["from"], r["score"]) for r in graph.page_links(df).collect()] == [("0/2", 0.9)]


def test_chain_crosses_a_page_and_is_cut(spark):
    text = "one two three four and so on with more words"
    rows = [region(0, text, 0.0), region(1, text, 12.0), region(0, text, 0.0, page=1)] + [region(i, text, 12.0 * i, page=1) for i in range(1, 50)]
    df = frame(spark, rows, REGION)
    e = graph.edges(df)
    over = [(r["from"], r["to"], r["score"]) for r in e.filter("cross_page").collect()]
    assert over == [("0/1", "1/0", 0.8)]
    m = graph.chain_members(df, e)
    assert m.count() == 40 and m.agg(F.max("length")).first()[0] == 40
    kept = {r["id"]: r["chain_position"] for r in graph.with_chains(df, m).collect()}
    assert kept["0/0"] == "1/40" and kept["1/49"] is None
    assert len(graph.chains(m).first()["source_joined"]) == 600


def test_reuse_needs_the_whole_key_and_takes_the_least_box(spark):
    rows = [("a", "Ok ⟦V_1⟧", {"V_1": "5 V"}, "cell", ["body"], 30.0), ("b", "Ok ⟦V_1⟧", {"V_1": "5 V"}, "cell", ["body", "body"], 20.0), ("c", "Ok ⟦V_1⟧", {"V_1": "9 V"}, "cell", ["body"], 1.0), ("d", "Ok ⟦V_1⟧", {"V_1": "5 V"}, "head", ["body"], 1.0)]
    df = frame(spark, rows, "id string, masked string, tokens map<string,string>, kind string, roles array<string>, area double")
    key = requests.reuse_key(F.col("masked"), F.col("tokens"), F.col("kind"), F.col("roles"), F.lit(0), F.lit(0))
    got = requests.reuse(df, [], key, F.col("area"), [])
    assert [tuple(r) for r in got.collect()] == [("a", "b")]
    regs = df.join(got, "id", "left").withColumn("text", F.lit("x"))
    out = requests.fan_out(regs, frame(spark, [("b", "Được ⟦V_1⟧")], "id string, masked_target string")).first()
    assert (out["id"], out["target"]) == ("a", "Được 5 V")


def test_rejects_come_in_order_and_locked_terms(spark):
    rows = [("a", None, "SCHEMA_INVALID"), ("a", "  ", "EMPTY_TARGET"), ("a ⟦URL_1⟧", "```x", "LLM_ARTIFACT"), ("a ⟦URL_1⟧", "x", "PLACEHOLDER_MISMATCH"), ("a ⟦URL_1⟧", "x ⟦URL_1⟧", None)]
    body = F.array(F.lit("body"))
    df = frame(spark, rows, "s string, t string, want string").select("want", requests.first_reject(F.col("s"), F.col("t"), F.lit(True), body, body).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    s, t = F.lit("Mount the Pack now"), F.lit("x")
    r = spark.range(1).select(requests.first_reject(s, t, F.lit(False), body, body), requests.first_reject(s, t, F.lit(True), body, F.array(F.lit("odd"))), requests.locked_violation(s, t, [("pack", "bộ pin")]), requests.locked_violation(F.lit("packing"), t, [("pack", "bộ pin")])).first()
    assert tuple(r) == ("ORPHAN_RESPONSE", "UNKNOWN_ROLE", "pack", None)


def test_severities_as_published():
    assert validation.SEVERITY["TRANSLATION_IDENTICAL"] == validation.SEVERITY["LLM_ARTIFACT"] == "P1" and validation.SEVERITY["TRANSLATION_CARRY_THROUGH"] == "P0"


def test_masks_of_brands_and_standards(spark):
    text = "Acme Pro and Acme per ISO 9001 and UN38.3, Ø12, AB12-C, 12 kWh at www.x.org or m@x.org"
    r = spark.range(1).select(T.mask(F.lit(text), ["Acme", "Acme Pro"]).alias("m")).select("m.*", T.restore(F.col("m.masked"), F.col("m.tokens")).alias("back")).first()
    assert r["back"] == text
    assert r["tokens"] == {"URL_1": "www.x.org", "EMAIL_1": "m@x.org", "BRAND_1": "Acme Pro", "BRAND_2": "Acme", "STD_1": "ISO 9001", "STD_2": "UN38.3", "MEAS_1": "12 kWh", "MODEL_1": "Ø12", "MODEL_2": "AB12-C"}
    odd = spark.range(1).select(T.restore(F.lit("a ⟦X_1⟧ ⟦Y_2⟧"), F.create_map(F.lit("X_1"), F.lit("$1\\")))).first()[0]
    assert odd == "a $1\\ ⟦Y_2⟧"


def test_actions(spark):
    none = F.create_map().cast("map<string,string>")
    kind = lambda t, rot=0, masked=None, tokens=none: requests.action(F.lit(t), F.lit(rot), F.lit(masked or t), tokens, ["Acme"])
    some = F.create_map(F.lit("URL_1"), F.lit("x"))
    got = spark.range(1).select(kind("x", -1), kind(" "), kind("12.5 / 3"), kind("ACME"), kind("www", 0, "(⟦URL_1⟧)", some), kind("12 V on")).first()
    assert [r["class"] for r in got] == ["arbitrary_angle", "empty", "numeric", "glossary_term", "protected_only", ""]


def test_addresses_fonts_and_words(spark):
    s = "Factory: No. 34 Jin Road, Fengxian District, 201406 Shanghai"
    kept, lost = "Nhà máy: No. 34 Jin Road, Fengxian District, 201406 Shanghai", "Số 34 Đường Jin, Quận Fengxian, Thượng Hải"
    r = spark.range(1).select(R.address_drift(F.lit(s), F.lit(kept)), R.address_drift(F.lit(s), F.lit(lost)), R.address_drift(F.lit("no such"), F.lit("x"))).first()
    assert r[0] == [] and set(r[1]) == {"No", "Road", "District", "Shanghai"} and r[2] == []
    f = spark.range(1).select(R.serif_font(F.lit("NotoSansSerif")), R.serif_font(F.lit("Times New")), R.serif_font(F.lit("Zz")), R.bold_font(F.lit("X-Bold"), F.lit(0)), R.bold_font(F.lit("X"), F.lit(16))).first()
    assert tuple(f) == (False, True, False, True, True)
    c = spark.range(1).select(T.carry_through(F.lit("press the red button twice"), F.lit("press the red button")), T.carry_through(F.lit("press the red button"), F.lit("nhấn the red button màu đỏ đã có"))).first()
    assert tuple(c) == (True, False)
    w = spark.range(1).select(R.digit_touches_token(F.lit("UN3 ⟦MODEL_1⟧")), R.digit_touches_token(F.lit("6.1 ⟦MODEL_1⟧")), R.unwrapped(F.create_map(F.lit("a"), F.lit("1\n V"))), T.source_key(F.lit("Pack-Q (2) 20240101"))).first()
    assert w[0] and not w[1] and w[2] == {"a": "1 V"} and w[3] == "pack"


def test_authenticity_of_a_marked_language(spark):
    s = "the pack must not be opened by anyone at home today"
    v = lambda t, keep=(): T.authenticity(F.lit(s), F.lit(t), keep, "vi")
    got = spark.range(1).select(v("le bloc ne doit pas etre ouvert par une personne chez soi"), v("bộ pin này không được mở bởi bất kỳ ai ở nhà hôm nay"), T.authenticity(F.lit("Acme Acme Acme pack"), F.lit("Acme Acme Acme pack"), ["Acme"], "vi")).first()
    assert tuple(got) == ("lang_suspect", None, None)


def test_rect_clusters_are_order_bound(spark):
    rng = random.Random(3)
    rects = [(x := rng.uniform(0, 80), y := rng.uniform(0, 80), x + rng.uniform(1, 8), y + rng.uniform(1, 8)) for _ in range(40)]

    def plain(rs, tol=3.0):
        for _ in range(6):
            used, out, merged = [False] * len(rs), [], False
            for i in range(len(rs)):
                if used[i]:
                    continue
                a = list(rs[i])
                for j in range(i + 1, len(rs)):
                    b = rs[j]
                    if not used[j] and max(a[0] - tol, b[0]) < min(a[2] + tol, b[2]) and max(a[1] - tol, b[1]) < min(a[3] + tol, b[3]):
                        a = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                        used[j] = merged = True
                out.append(tuple(a))
            rs = out
            if not merged:
                break
        return [tuple(round(v, 2) for v in r) for r in rs]

    df = frame(spark, [("j", 1, n, r) for n, r in enumerate(rects)], f"job string, page int, n int, {BOX}")
    got = [tuple(r)[3:] for r in layout.clustered_rects(df).orderBy("cluster").collect()]
    assert got == plain(rects) and len(got) < 40


def test_alignment_by_agreement_spread_and_gaps(spark):
    cases = {"left": [(10, 50), (10, 80), (10.5, 60)], "right": [(30, 90), (50, 90), (44, 90)], "center": [(20, 80), (30, 70), (40, 60)]}
    rows = [(k, n, (float(a), 0.0, float(b), 9.0)) for k, v in cases.items() for n, (a, b) in enumerate(v)] + [("single", 0, (40.0, 0.0, 62.0, 9.0)), ("far", 0, (80.0, 0.0, 99.0, 9.0))]
    c = F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 2.0), ("y0", 0.0), ("x1", 100.0), ("y1", 9.0))])
    got = {r["g"]: r["alignment"] for r in layout.alignment(frame(spark, rows, f"g string, n int, {BOX}"), ["g"], c).collect()}
    assert got == {"left": "left", "right": "right", "center": "center", "single": "center", "far": "right"}


def test_label_clusters_follow_leaders(spark):
    rows = [(1, n, "ab", (x, y, x + w, y + 9)) for n, (x, y, w) in enumerate([(0.0, 0.0, 10.0), (7.0, 10.0, 40.0), (14.0, 0.0, 10.0), (60.0, 5.0, 30.0)])]
    df = frame(spark, rows, f"g int, n int, text string, {BOX}")
    got = {r["n"]: r["cluster"] for r in layout.label_clusters(df, ["g"]).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3


def test_row_split_at_a_rule(spark):
    words = [(0.0, 20.0, "ab"), (60.0, 80.0, "cd"), (84.0, 90.0, "ef")]
    lines = frame(spark, [("j", 1, "l", words, 0.0, 10.0)], "job string, page int, id string, words array<struct<x0:double,x1:double,text:string>>, y0 double, y1 double")
    rule = lambda x: frame(spark, [("j", 1, x, -5.0, 50.0)], "job string, page int, x double, y0 double, y1 double")
    cut = lambda x: [r["text"] for r in layout.split_rows(lines, rule(x)).orderBy("x0").collect()]
    assert cut(40.0) == ["ab", "cd ef"] and cut(10.0) == ["ab cd ef"]


LINE = f"job string, page int, region string, id string, n int, text string, size double, baseline double, {BOX}, container struct<x0:double,y0:double,x1:double,y1:double>"


def line(i, text, x0, x1, base, size=10.0):
    return ("j", 1, "r", str(i), i, text, size, base, (x0, base - 9.0, x1, base + 1.0), (0.0, 0.0, 300.0, 100.0))


def test_hosts_bullets_blanks_and_leaders(spark):
    df = frame(spark, [line(0, "charge current", 10.0, 80.0, 20.0), line(1, "[1]", 81.0, 88.0, 16.0, 6.0), line(2, "other", 10.0, 60.0, 50.0)], LINE)
    assert [(r["id"], r["host"]) for r in layout.superscript_hosts(df, ["job", "page"]).collect()] == [("1", "0")]
    marks = frame(spark, [("j", 1, 1, (2.0, 14.0, 6.0, 18.0)), ("j", 1, 2, (200.0, 14.0, 206.0, 18.0))], f"job string, page int, mark int, {BOX}")
    reg = frame(spark, [("j", 1, "r", (2.0, 10.0, 90.0, 55.0))], f"job string, page int, region string, {BOX}")
    assert [r["n"] for r in layout.bullet_lines(df.filter("id <> '1'"), marks, reg).collect()] == [0]
    rules = frame(spark, [("j", 1, 1, (62.0, 50.0, 100.0, 50.5)), ("j", 1, 2, (82.0, 21.0, 120.0, 21.5))], f"job string, page int, rule int, {BOX}")
    both = frame(spark, [line(0, "name", 10.0, 60.0, 50.0), line(1, "date", 102.0, 140.0, 50.5), line(2, "label", 10.0, 80.0, 20.0)], LINE)
    assert [r["rule"] for r in layout.fill_rules(both, rules).collect()] == [1]
    ink = frame(spark, [("j", 1, "t", (10.0, 0.0, 50.0, 10.0)), ("j", 1, "no", (206.0, 0.0, 212.0, 10.0))], f"job string, page int, region string, {BOX}")
    strokes = frame(spark, [("j", 1, True, (52.0, 8.0, 200.0, 8.2))], f"job string, page int, dashed boolean, {BOX}")
    assert [(r["region"], r["gap"]) for r in layout.leader_runs(ink, strokes).collect()] == [("t", 2.0)]
    assert layout.leader_runs(ink.filter("region = 't'"), strokes).count() == 0


def test_grid_anchor_needs_two_votes(spark):
    rows = [("j", 1, "r", 12.0 * k, 0.0, 40.0) for k in range(3)] + [("j", 1, "r", 12.0 * k, 100.0 + k, 150.0) for k in range(2)]
    df = frame(spark, rows, "job string, page int, region string, baseline double, x0 double, x1 double")
    assert [(r["anchor"], r["votes"]) for r in layout.grid_anchor(df).collect()] == [(100.0, 2)]
    assert layout.grid_anchor(df.filter("baseline < 12")).count() == 0


def test_paragraphs_merge_while_the_merged_links(spark):
    rows = [region(0, "one two three four", 0.0), region(1, "five", 12.0), region(2, "six end.", 24.0), region(3, "not this one here", 36.0)]
    got = layout.merged_paragraphs(frame(spark, rows, REGION)).orderBy("idx").collect()
    assert [(r["merged"], r["text"].count("\n")) for r in got] == [(3, 2), (1, 0)]


def test_run_roles(spark):
    rows = [("g", 0, "Note:", 10.0, True), ("g", 1, "long body text here", 10.0, False), ("h", 0, "BIG WORDS", 14.0, False), ("h", 1, "small words here", 10.0, False), ("k", 0, "Only:", 10.0, True)]
    got = {(r["g"], r["run"]): r["role"] for r in layout.run_roles(frame(spark, rows, "g string, run int, text string, size double, bold boolean"), ["g"]).collect()}
    assert got == {("g", 0): "label", ("g", 1): "body", ("h", 0): "emphasis", ("h", 1): "body", ("k", 0): "body"}
    cut = spark.range(1).select(layout.sliced_runs(F.array(F.struct(F.lit("abc").alias("text")), F.struct(F.lit("defg").alias("text"))), F.lit(2), F.lit(3)), layout.sliced_runs(F.array(F.struct(F.lit("abc").alias("text"))), F.lit(2), F.lit(3))).first()
    assert [r["text"] for r in cut[0]] == ["c", "de"] and cut[1] is None


def test_images_match_one_to_one(spark):
    schema = f"job string, page int, n int, digest string, {BOX}"
    b = (0.0, 0.0, 10.0, 10.0)
    want = frame(spark, [("j", 1, 0, "d", b), ("j", 1, 1, "d", b), ("j", 1, 2, "d", (50.0, 0.0, 60.0, 9.0))], schema)
    have = frame(spark, [("j", 1, 0, "d", (0.6, 0.0, 10.0, 10.0))], schema)
    assert {r["want"]: r["have"] for r in gates.matched_images(want, have).collect()} == {0: 0, 1: None, 2: None}


def test_gates(spark):
    f = frame(spark, [("a", False, 0, 100, 200), ("b", True, 2, 100, 400)], "job string, encrypted boolean, annotations int, source_bytes int, draft_bytes int")
    assert {(r["job"], r["code"]) for r in gates.structure(f).collect()} == {("b", "G7_ENCRYPTED"), ("b", "G7_ANNOTATIONS"), ("b", "G7_SIZE")}
    found = frame(spark, [("a", "X", "P1"), ("b", "Y", "P0")], "job string, code string, severity string")
    waive = frame(spark, [("a", "X"), ("b", "Y")], "job string, code string")
    js = frame(spark, [("a", False, "NEEDS_REVIEW", True), ("b", False, "NEEDS_REVIEW", True), ("c", True, "AUTO_QA_PASS", True)], "job string, partial boolean, status string, human boolean")
    assert {r["job"]: r["released"] for r in gates.release(js, found, waive).collect()} == {"a": True, "b": False, "c": False}
    t = frame(spark, [("j", 1, "m", (10.0, 10.0, 20.0, 20.0))], f"job string, page int, id string, {BOX}")
    near = frame(spark, [("j", 1, (20.3, 10.0, 30.0, 20.0))], f"job string, page int, {BOX}")
    over = frame(spark, [("j", 1, (19.0, 10.0, 30.0, 20.0))], f"job string, page int, {BOX}")
    assert gates.masks(t, near).first()["pad"] == 0.05 and gates.masks(t, over).first()["conflict"]
    p = frame(spark, [("j", 1, x, 0, x < 20) for x in range(48)], "job string, page int, x int, y int, changed boolean")
    assert [(r["tx"], r["share"]) for r in layout.tiles(p).collect()] == [(0, 20 / 24)]
    flags = frame(spark, [("a", False, False)] * 30 + [("a", True, False)], "job string, identical boolean, suspect boolean")
    assert not gates.integrity(found, flags).first()["passed"] and gates.integrity(found.limit(0), flags).first()["passed"]


def test_fitting_by_metrics(spark):
    metrics = frame(spark, [("f", ord(c), 0.5) for c in "ab"], "font string, codepoint int, advance_em double")
    words = frame(spark, [("r", 0, "f", "aab"), ("r", 1, "f", "b"), ("r", 2, "f", "ab")], "id string, n int, font string, word string")
    w = fit.advances(words, metrics).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "em"))).alias("w"))
    got = w.select(fit.wrapped_by_width("w", F.lit(20.0), F.lit(10.0)), fit.wrapped_by_width("w", F.lit(14.0), F.lit(10.0)), fit.fitted_size("w", F.lit(20.0), F.lit(20.0), 4.0, F.lit(12.0)).alias("s")).first()
    assert got[0] == 2 and got[1] is None and 7.9 < got[2] < 8.7
    assert [tuple(r) for r in spark.range(1).select(fit.fit_issue(F.lit(9.2), F.lit(10.0)), fit.fit_issue(F.lit(8.0), F.lit(10.0)), fit.fit_issue(F.lit(None).cast("double"), F.lit(10.0)), fit.fit_issue(F.lit(10.0), F.lit(10.0))).collect()] == [("FONT_RATIO_REVIEW", "FONT_RATIO_HARD", "FIT_IMPOSSIBLE", None)]


def test_fonts_columns_and_expansion(spark):
    spans = frame(spark, [("1", "A", "serif", "ab"), ("2", "Q", "serif", "aз")], "id string, name string, style string, text string")
    fonts = frame(spark, [("A", "serif", "fa")], "name string, style string, face string")
    cover = frame(spark, [("fa", ord("a")), ("fa", ord("b")), ("nb", ord("a"))], "face string, codepoint int")
    assert {r["id"]: (r["face"], r["missing"]) for r in fit.resolved_fonts(spans, fonts, cover, "nb").collect()} == {"1": ("fa", 0), "2": ("nb", 1)}
    parts = spark.range(1).select(fit.split_columns(F.lit("Packing list ......... 9"))).first()[0]
    assert [p["text"] for p in parts] == ["Packing list", "9"]
    b = frame(spark, [("j", 1, "a", True, False, (0.0, 0.0, 10.0, 10.0)), ("j", 1, "b", True, False, (30.0, 0.0, 40.0, 10.0))], f"job string, page int, id string, movable boolean, centred boolean, {BOX}")
    assert {r["id"]: r["x1"] for r in fit.expanded(b, b, 100.0).collect()} == {"a": 20.0, "b": 100.0}


def test_containers_stop_at_neighbours(spark):
    df = frame(spark, [("j", 1, "a", (50.0, 50.0, 100.0, 60.0)), ("j", 1, "b", (110.0, 50.0, 140.0, 60.0))], f"job string, page int, id string, {BOX}")
    page = F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 300.0), ("y1", 200.0))])
    got = {r["id"]: r for r in layout.containers(df, df, page).collect()}
    assert got["a"]["container"]["x1"] == 108.0 and got["b"]["container"]["x1"] == 162.0 and got["b"]["left_limit"] == 102.0


def test_page_sources(spark):
    t = frame(spark, [("j", 1, "a", 0, "seen", (0.0, 0.0, 10.0, 10.0), [(0.0, 0.0, 5.0, 10.0)]), ("j", 1, "b", 0, "hid den", (0.0, 50.0, 10.0, 60.0), [(0.0, 50.0, 5.0, 60.0)]), ("j", 1, "c", 3, "ghost", (0.0, 50.0, 10.0, 60.0), [(0.0, 50.0, 5.0, 60.0)]), ("j", 1, "d", 0, "off", (-90.0, 50.0, 10.0, 60.0), [(0.0, 50.0, 5.0, 60.0)])], f"job string, page int, id string, type int, text string, {BOX}, chars array<struct<x0:double,y0:double,x1:double,y1:double>>")
    prim = frame(spark, [("j", 1, "it is se en")], "job string, page int, text string")
    known = frame(spark, [("j", 1, (0.0, 0.0, 100.0, 20.0))], f"job string, page int, {BOX}")
    page = F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 100.0), ("y1", 100.0))])
    assert [r["id"] for r in vectors.hidden_text(t, prim, known, page).collect()] == ["b"]
    found = frame(spark, [("j", 1, 2, 2, 4, None), ("j", 2, 1, 5, 5, None), ("j", 3, 0, 0, 0, "bad")], "job string, page int, rows int, cols int, cells int, error string")
    good, bad = vectors.usable_tables(found)
    assert [r["page"] for r in good.collect()] == [1] and [r["page"] for r in bad.collect()] == [3]
    inv = frame(spark, [("a", "texty"), ("b", "scanned"), ("c", "texty"), ("d", "texty")], "job string, kind string")
    iss = frame(spark, [("a", "P0"), ("c", "P1")], "job string, severity string")
    assert {r["job"]: r["class"] for r in vectors.document_class(inv, iss).collect()} == {"a": "REJECTED", "b": "MANUAL_DTP_REQUIRED", "c": "SUPPORTED_WITH_REVIEW", "d": "SUPPORTED"}
    ch = frame(spark, [("j", 1, 0.0, 10.02, "B", "a"), ("j", 1, 1.0, 10.01, "B", "b"), ("j", 1, 2.0, 10.0, "R", "c"), ("j", 1, 0.0, 30.0, "R", "d")], "job string, page int, x double, baseline double, style string, c string")
    assert sorted(r["text"] for r in vectors.baseline_rows(ch).collect()) == ["ab", "c", "d"]


def test_job_control(spark, tmp_path):
    with pytest.raises(jobs.Blocked):
        jobs.guard("RELEASED")
    jobs.guard("NEEDS_REVIEW")
    (tmp_path / "c.yaml").write_text("a: 1\n# note\nfonts:\n  minimum_ratio: 0.9  # x\n  name: 'y'\nb: 2\n")
    assert jobs.read_config(spark, f"{tmp_path}/c.yaml") == {"a": "1", "fonts.minimum_ratio": "0.9", "fonts.name": "y", "b": "2"}
    df = frame(spark, [("j", {"a": "9"}, "NEW")], "job string, config map<string,string>, status string")
    assert jobs.with_defaults(df, "config", {"a": "1", "b": "2"}).first()["config"] == {"a": "9", "b": "2"}
    st = df.withColumn("stages", F.create_map(F.lit("x"), F.struct(F.lit("done").alias("state"), F.lit("t").alias("ts"), F.lit("e").alias("engine"))))
    assert jobs.stamped(st, "x", "failed", "e2", F.lit("2024-01-02 03:04:05").cast("timestamp")).first()["stages"]["x"]["ts"] == "2024-01-02T03:04:05Z"
    allowed = frame(spark, [("NEW", "PREFLIGHTED")], "from_status string, to_status string")
    ok, no = jobs.transition(df.unionByName(df.withColumn("status", F.lit("OLD"))), "PREFLIGHTED", allowed)
    assert ok.count() == 1 and no.first()["status"] == "OLD"
    out = jobs.promote(df.select("job"), f"{tmp_path}/release")
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(jobs.Blocked):
        jobs.promote(df.select("job"), out)
    files.append_jsonl(df.select("job"), f"{tmp_path}/log")
    files.append_jsonl(df.select("job"), f"{tmp_path}/log")
    assert files.read_jsonl(spark, f"{tmp_path}/log", "job string").count() == 2
    assert vectors.sibling_files(spark, str(tmp_path), "c-Q (1)", "*.yaml").count() == 1
    digests = spark.range(1).select(R.config_digest(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))), R.config_digest(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()
    assert digests[0] == digests[1]
    assert spark.range(1).select(R.job_id(F.lit("My File"), F.lit("x").cast("binary"), F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "my_file__2d711642__20240102T030405Z"
