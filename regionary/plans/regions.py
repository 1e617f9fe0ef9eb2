"""Queries of the region operators over a layout made of the documents: pieces of twelve words with boxes by rule.

The tables hold no pages, so each document is a job, twenty pieces make a page, and a piece's length decides its kind, box and
size. Both engines make the same layout; the operators under test are those of the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reading as R
from ..functions import rects
from ..functions import text as T
from ..operators import fit, gates, graph, grouping, layout, requests
from ..sources import vectors
from .catalogue import query, table

PIECE, PER_PAGE = 12, 20
_KIND = "case when n < 25 then 'heading' when n % 11 = 0 then 'diagram_label' when n % 11 = 1 then 'figure_caption' when n % 6 = 0 then 'list_item' when n % 9 = 0 then 'table_cell' else 'paragraph' end"

REGIONS = f"""w as (select doc_id, string_split(replace(text, chr(10), ' '), ' ') w from documents where text is not null),
c as (select doc_id job, i, trim(array_to_string(w[i * {PIECE} + 1:i * {PIECE} + {PIECE}], ' ')) as text from (select doc_id, w, unnest(range(0, (len(w) + {PIECE - 1}) // {PIECE})) i from w) t),
r0 as (select job, i // {PER_PAGE} page, i % {PER_PAGE} idx, concat(job, '/', i) id, text, length(text) n from c),
r1 as (select *, {_KIND} kind, (40 + n % 4 * 5)::double x0, (idx * 14 + case when n % 7 = 0 then 9 else 0 end)::double y0, 9 + n % 5 * 0.25::double size from r0),
r as (select *, x0 + 4 * least(n, 100) x1, y0 + 10 + n % 3 y1 from r1)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, page, idx, id, kind, text, n, box, size, n_lines, rotation)."""
    w = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("job"), F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w"))
    last = F.floor((F.size("w") + (PIECE - 1)) / PIECE).cast("int") - 1
    c = w.select("job", F.col("w"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    c = c.select("job", "i", F.trim(F.array_join(F.slice("w", F.col("i") * PIECE + 1, PIECE), " ")).alias("text")).withColumn("n", F.length("text"))
    idx = F.col("i") % PER_PAGE
    x0, y0 = (40 + F.col("n") % 4 * 5).cast("double"), (idx * 14 + F.when(F.col("n") % 7 == 0, 9).otherwise(0)).cast("double")
    box = rects.rect(x0, y0, x0 + 4 * F.least("n", F.lit(100)), y0 + 10 + F.col("n") % 3)
    return c.select(
        "job",
        F.floor(F.col("i") / PER_PAGE).alias("page"),
        idx.cast("long").alias("idx"),
        F.concat(F.col("job"), F.lit("/"), F.col("i")).alias("id"),
        F.expr(_KIND).alias("kind"),
        "text",
        "n",
        box.alias("box"),
        (9 + F.col("n") % 5 * 0.25).cast("double").alias("size"),
        F.lit(1).alias("n_lines"),
        F.lit(0).alias("rotation"),
    )


_FLOW, _LABELS = "('paragraph', 'list_item')", "('figure_caption', 'diagram_label')"
_SOFT = "not regexp_matches(rtrim({}), '[.:;!?…。][''\"’”)\\]]?$')"
_LINKS = f"""p as (select *, median(y1 - y0) over (partition by job, page) lh, lead(struct_pack(id := id, kind := kind, text := text, x0 := x0, y0 := y0, x1 := x1, y1 := y1, size := size, idx := idx)) over (partition by job, page order by idx) b from r),
l0 as (select *, b.y0 - y1 gap, abs(b.x0 - x0) dx from p where b.idx - idx = 1),
l1 as (select job, page, id as from_id, b.id as to_id, case when kind in {_FLOW} and b.kind in {_FLOW} and not regexp_matches(text, '^\\s*[0-9]+([.][0-9]+)*[.\\s]\\s*\\S') and not contains(text, '....') and not contains(b.text, '....')
and not regexp_matches(b.text, '^\\s*({'|'.join(R.CAPTION_WORDS)})\\s+[0-9]') and not regexp_matches(b.text, '^\\s*\\p{{L}}[\\p{{L}}0-9_ ]{{0,14}}[:：]\\s') and {_SOFT.format('text')}
and len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 4 and gap between 0 and 0.7::double * lh and dx <= 10 and abs(b.size - size) <= 0.5::double
then round(1 - 0.3::double * gap / greatest(lh, 1) - 0.1::double * dx / 10, 3)
when kind in {_LABELS} and b.kind in {_LABELS} and gap between -1 and 0.12::double * greatest(y1 - y0, 1) and (dx <= 8 or abs((x0 + x1) / 2 - (b.x0 + b.x1) / 2) <= 8 or abs(x1 - b.x1) <= 8) then 0.9::double end score from l0),
links as (select * from l1 where score is not null)"""
_SIBS = f"sibs as (select job, page, id as from_id, lead(id) over q to_id, lead(idx) over q - idx d from r where kind in {_LABELS} window q as (partition by job, page order by idx)), sib as (select job, page, from_id, to_id from sibs where d <= 2)"
_BREAKS = f"""e as (select job, page, max_by(struct_pack(id := id, text := text), idx) a, min_by(struct_pack(id := id, text := text), idx) f from r where kind in {_FLOW} group by job, page),
brk as (select x.job, x.page, x.a.id as from_id, y.f.id as to_id from e x join e y on x.job = y.job and y.page = x.page + 1 where length(trim(x.a.text)) > 25 and {_SOFT.format('trim(x.a.text)')} and regexp_matches(trim(y.f.text), '^\\p{{Ll}}'))"""
_EDGES = f"""edges as (select job, 'continues' as type, from_id, to_id, score, false cross_page from links union all select job, 'continues', from_id, to_id, 0.8::double, true from brk b where not exists (select 1 from links l where l.job = b.job and l.from_id = b.from_id)
union all select job, 'co_figure', from_id, to_id, 0.6::double, false from sib)"""
_CHAINS = f"""f as (select r.*, case when kind in {_LABELS} then 'label_stack' else 'flow' end family, t.to_id is not null linked from r left join (select distinct job, to_id from edges where type = 'continues') t on t.job = r.job and t.to_id = r.id where kind in {_FLOW} or kind in {_LABELS}),
g as (select *, sum(case when linked then 0 else 1 end) over (partition by job, family order by page, idx) run from f), h as (select *, row_number() over (partition by job, family, run order by page, idx) as position from g),
m0 as (select * from h where position <= 40), m as (select *, count(*) over (partition by job, family, run) length, first_value(id) over (partition by job, family, run order by page, idx) chain from m0), mem as (select * from m where length > 1)"""
_GRAPH = f"{REGIONS}, {_LINKS}, {_SIBS}, {_BREAKS}, {_EDGES}"


@query(f"with {REGIONS}, {_LINKS} select job, page, from_id, to_id, score from links")
def jn13_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_links(regions(spark, sf_dir)).withColumnsRenamed({"from": "from_id", "to": "to_id"})


@query(f"with {REGIONS}, {_BREAKS} select * from brk")
def jn14_page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_breaks(regions(spark, sf_dir)).withColumnsRenamed({"from": "from_id", "to": "to_id"})


@query(f"with {REGIONS}, {_SIBS} select * from sib")
def wn9_sibling_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sibling_labels(regions(spark, sf_dir)).withColumnsRenamed({"from": "from_id", "to": "to_id"})


@query(f"with {_GRAPH} select * from edges")
def gr1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(regions(spark, sf_dir)).withColumnsRenamed({"from": "from_id", "to": "to_id"})


@query(f"with {_GRAPH}, {_CHAINS} select r.job, r.id, mem.chain, mem.position::varchar || '/' || mem.length::varchar chain_position from r left join mem on mem.job = r.job and mem.id = r.id")
def gr3_chain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3 and GR4."""
    r = regions(spark, sf_dir)
    return graph.with_chains(r, graph.chain_members(r, graph.edges(r))).select("job", "id", "chain", "chain_position")


@query(f"with {_GRAPH}, {_CHAINS} select job, chain, family chain_kind, count(*) members, substr(string_agg(trim(text), ' ' order by position), 1, 600) source_joined from mem group by all")
def gr4_chain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2 with kind and joined text, and GR4's cut."""
    r = regions(spark, sf_dir)
    return graph.chains(graph.chain_members(r, graph.edges(r))).select("job", "chain", "chain_kind", F.size("region_ids").cast("long").alias("members"), "source_joined")


@query(f"""with {REGIONS}, {_SIBS}, b as (select job, from_id id, to_id o from sib union select job, to_id, from_id from sib) select job, id, array_to_string(list_slice(list_sort(list(o)), 1, 4), ',') siblings from b group by job, id""")
def gr5_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.siblings(graph.edges(regions(spark, sf_dir))).select("job", "id", F.array_join("siblings", ",").alias("siblings"))


@query(f"""with {_GRAPH}, {_CHAINS}, x as (select job, count(*) regions from r group by job), y as (select job, count(*) filter (where type = 'continues') c, count(*) filter (where type = 'co_figure') f from edges group by job), z as (select job, count(distinct chain) n, max(length) l from mem group by job)
select x.job, regions, coalesce(c, 0) continues, coalesce(f, 0) co_figure, coalesce(n, 0) chains, coalesce(l, 0) chains_max_len from x left join y on x.job = y.job left join z on x.job = z.job""")
def ag20_context_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    e = graph.edges(r)
    return graph.statistics(r, e, graph.chain_members(r, e))


@query(f"""with {REGIONS}, h as (select *, min(case when kind = 'table_cell' then y0 end) over (partition by job, page) top from r),
t as (select job, page, list_slice(list(text order by idx) filter (where kind = 'table_cell' and y0 - top <= 3), 1, 8) heads from h group by job, page)
select r.job, r.page, r.idx, r.id, last_value(case when kind = 'heading' then text end ignore nulls) over q heading, right(lag(text) over q, 240) prev, left(lead(text) over q, 240) as next,
case when kind = 'table_cell' then array_to_string(t.heads, '|') end headers, greatest(1, floor((y1 - y0) / (1.15::double * size)))::int max_lines
from r join t on t.job = r.job and t.page = r.page window q as (partition by r.job, r.page order by idx rows between unbounded preceding and current row)""".replace("lead(text) over q", "lead(text) over (partition by r.job, r.page order by idx)").replace("lag(text) over q", "lag(text) over (partition by r.job, r.page order by idx)"))
def rg6_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RG6, WN7, SC22, SC24."""
    out = requests.requests(regions(spark, sf_dir).withColumn("masked", F.col("text")))
    return out.select("job", "page", "idx", "id", "context.heading", "context.prev", "context.next", F.array_join("context.table_headers", "|").alias("headers"), "length_guidance.max_lines")


_URLS = r"(?:[a-z]+://|www[.])[^\s⟦⟧]+"


@query(f"""with {REGIONS}, k as (select *, lower(text) as key, round((x1 - x0) * (y1 - y0), 3) area from r where kind in ('heading', 'table_cell')), b as (select key, kind, min((area, page, idx, id)) best, count(*) n from k group by key, kind having count(*) > 1)
select k.id, best[4] reuse_of from k join b using (key, kind) where k.id <> best[4]""")
def ag11_reuse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: headings and cells of equal text and kind over all jobs; the least box stands for them."""
    r = regions(spark, sf_dir).filter("kind in ('heading', 'table_cell')")
    none = F.lit(0)
    key = requests.reuse_key(F.lower("text"), F.create_map().cast("map<string,string>"), F.col("kind"), F.array(F.lit("body")), none, none)
    return requests.reuse(r, [], key, rects.area(F.col("box")), ["page", "idx"]).select("id", "reuse_of")


@query(f"""with {REGIONS}, s as (select *, x0 + case when idx % 2 = 0 then 0 else 300 end ax, x1 / 4 + case when idx % 2 = 0 then 0 else 300 end bx, case when n % 17 = 0 then 90 else 0 end rot from r),
g as (select *, (ax + bx) / 2 < 300 is_left from s), t as (select job, page, count(*) filter (where rot = 0) c, count(*) filter (where rot = 0 and is_left) cl, count(*) filter (where rot = 0 and not is_left) cr, min(case when rot = 0 and not is_left then ax end) - max(case when rot = 0 and is_left then bx end) gut from g group by job, page),
u as (select g.*, coalesce(c >= 6 and cl >= 2 and cr >= 2 and gut > 0.06::double * 600, false) two from g join t using (job, page))
select job, id, two two_columns, (row_number() over (partition by job, page order by case when rot <> 0 then 1 else 0 end, case when two and rot = 0 and not is_left then 1 else 0 end, case when rot <> 0 then rot when two then y0 else round_even(y0 / 4, 0) end, case when rot <> 0 then y0 else ax end, ax, id) - 1)::int reading_index from u""")
def st2_reading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, ST3: pieces dealt to two columns, some of them turned."""
    off = F.when(F.col("idx") % 2 == 0, 0).otherwise(300)
    r = regions(spark, sf_dir).withColumn("rotation", F.when(F.col("n") % 17 == 0, 90).otherwise(0))
    r = r.withColumn("box", rects.rect(F.col("box.x0") + off, F.col("box.y0"), F.col("box.x1") / 4 + off, F.col("box.y1")))
    return layout.reading_index(r, F.lit(600)).select("job", "id", "two_columns", "reading_index")


@query(f"""with {REGIONS} select job, id, case when size >= 11.25 and length(trim(text)) < 120 then 'heading' when regexp_matches(trim(text), '^([•◦▪‣*-]|[0-9]{{1,3}}[.)]|[A-Za-z][.)])\\s*\\S') then 'list_item'
when idx % 4 = 0 and length(trim(text)) < 200 then 'figure_caption' when (idx % 4 = 0 or idx % 4 = 1) and length(trim(text)) <= 40 and size <= 0.95::double * 9 then 'diagram_label' when y0 > 0.88::double * 280 and size < 0.85::double * 11.5 then 'footnote' else 'paragraph' end found from r""")
def flt6_region_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    kind = layout.region_kind(F.col("size") + F.when(F.col("size") < 11.25, 0.0).otherwise(0.0), F.lit(9.0), F.col("n_lines"), F.col("text"), F.col("idx") % 4 == 0, F.col("idx") % 4 == 1, F.col("box"), F.lit(280.0))
    foot = layout.region_kind(F.col("size"), F.lit(11.5), F.col("n_lines"), F.col("text"), F.lit(False), F.lit(False), F.col("box"), F.lit(280.0))
    return r.select("job", "id", F.when((kind == "paragraph") & (foot == "footnote"), "footnote").otherwise(kind).alias("found"))


@query(f"""with {REGIONS}, s as (select *, max(x1) over (partition by job, page) edge, lag(x1) over (partition by job, page order by idx) before from r)
select job, id, idx = 0 or coalesce(edge - before >= (x1 - x0) / length(trim(text)) * (length(string_split(trim(text), ' ')[1]) + 1), false) starts from s""")
def wn12_paragraph_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraph_starts(regions(spark, sf_dir).withColumn("n", F.col("idx")), ["job", "page"]).select("job", "id", "starts")


@query(f"""with {REGIONS} select job, page, id, 'G4_RATIO_FLOOR' code, 'P0' severity from r where size / 11 < (case when n % 17 = 0 then 0.6::double else 0.85::double end) - 1e-6::double
union all select job, page, id, 'G4_OUT_OF_CONTAINER', 'P1' from r where x1 - 400 > 1 or y1 - (idx * 14 + 12) > greatest(1, 0.6::double * size)
union all select job, page, id, 'G4_BOTTOM_SLACK', 'P2' from r where not (x1 - 400 > 1 or y1 - (idx * 14 + 12) > greatest(1, 0.6::double * size)) and y1 - (idx * 14 + 12) > 1""")
def gt4_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("ratio", F.col("size") / 11).withColumn("container", rects.rect(F.lit(40.0), F.col("idx") * 14.0, F.lit(400.0), F.col("idx") * 14.0 + 12))
    turned = r.withColumn("rotation", F.when(F.col("n") % 17 == 0, 90).otherwise(0))
    return gates.ratio_floor(turned).unionByName(gates.overflow(r))


@query(f"""with {REGIONS}, v as (select distinct job, page, x0 + 60 x, y0 - 20 r0, y1 + 20 r1 from r where kind = 'list_item')
select distinct r.job, r.page, r.id, 'G4_TABLE_RULE_CROSS' code, 'P1' severity from r join v on r.job = v.job and r.page = v.page where kind = 'table_cell' and x0 + 1 < x and x < x1 - 1 and r0 < y1 - 0.5 and r1 > y0 + 0.5""")
def jn9_rule_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    rules = r.filter("kind = 'list_item'").select("job", "page", (F.col("box.x0") + 60).alias("x"), (F.col("box.y0") - 20).alias("y0"), (F.col("box.y1") + 20).alias("y1"))
    return gates.rule_crossings(r, rules)


@query(f"""with {REGIONS}, a as (select * from r where kind = 'table_cell'), b as (select * from r where kind <> 'table_cell')
select distinct a.job, a.page, a.id, 'G4_COLLISION' code, 'P1' severity from a join b on a.job = b.job and a.page = b.page where greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1""")
def gt4_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    return gates.collisions(r.filter("kind = 'table_cell'"), r.filter("kind <> 'table_cell'"))


@query(f"""with {REGIONS}, cap as (select * from r where kind = 'figure_caption'), d as (select job, page, n, x0, y0, x1 from cap where n % 2 = 0),
k as (select c.* from cap c where not exists (select 1 from d where d.job = c.job and d.page = c.page and abs(c.x0 - d.x0) <= 1.5 and abs(c.y0 - d.y0) <= 1.5 and abs(c.x1 - d.x1) <= 1.5)),
w as (select job, page, count(*) wanted from k group by job, page), h as (select job, page, count(*) found from r where kind = 'list_item' group by job, page)
select job, page, coalesce(wanted, 0) wanted, coalesce(found, 0) found from w full join h using (job, page) where coalesce(wanted, 0) <> coalesce(found, 0)""".replace("w as (select job, page, count(*) wanted", "w2 as (select job, page, count(*) wanted").replace("from w full join", "from w2 full join"))
def jn20_lost_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    c = r.filter("kind = 'figure_caption'")
    return gates.lost_clusters(c.withColumn("n", F.col("idx")), r.filter("kind = 'list_item'"), c.filter("n % 2 = 0"))


@query(f"""with {REGIONS}, i as (select * from r where kind = 'list_item')
select distinct a.job, a.page, a.id from r a join i on a.job = i.job and a.page = i.page where greatest(0, least(a.x1, i.x1) - greatest(a.x0, i.x0)) * greatest(0, least(a.y1, i.y1) - greatest(a.y0, i.y0)) >= 0.85::double * (a.x1 - a.x0) * (a.y1 - a.y0)""")
def jn22_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    return layout.occlusion_candidates(r, r.filter("kind = 'list_item'"))


@query(f"""with {REGIONS}, m as (select job, page, id, y1 y from r where kind = 'diagram_label'), o as (select job, page, idx as "row", y0 ry from r where kind = 'list_item') select m.job, m.page, id, min_by("row", (abs(y - ry), "row")) as "row" from m join o on m.job = o.job and m.page = o.page group by all""")
def jn21_nearest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    rows = r.filter("kind = 'list_item'").select("job", "page", F.col("idx").alias("row"), F.col("box.y0").alias("ry"))
    return layout.nearest_row(r.filter("kind = 'diagram_label'").select("job", "page", "id", F.col("box.y1").alias("y")), rows, ["job", "page"])


@query(f"""with {REGIONS}, b as (select *, case when n % 9 = 0 then x0 + 1 else x1 end bx from r where kind <> 'heading')
select job, page, (x0 + bx) / 2 x, y0, y1 from b where bx - x0 <= 1.5 union all select job, page, unnest([x0, bx]), y0, y1 from b where bx - x0 > 1.5 and n % 2 = 0""")
def src8_vertical_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).filter("kind <> 'heading'")
    box = rects.rect(F.col("box.x0"), F.col("box.y0"), F.when(F.col("n") % 9 == 0, F.col("box.x0") + 1).otherwise(F.col("box.x1")), F.col("box.y1"))
    return vectors.vertical_rules(r.select("job", "page", (F.col("n") % 2 == 0).alias("stroked"), F.lit("re").alias("op"), box.alias("box")))


@query(f"""with {REGIONS} select job, page, x0, y0, x1, y0 + n % 4 y1 from r where n % 4 <= 1.5 and x1 - x0 >= 10 and n % 5 <> 0""")
def src9_horizontal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    box = rects.rect(F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y0") + F.col("n") % 4)
    return vectors.horizontal_rules(r.select("job", "page", F.when(F.col("n") % 5 == 0, "[3] 0").alias("dashes"), box.alias("box"))).select("job", "page", "box.*")


@query(f"""with {REGIONS}, p as (select distinct job, page from r), i as (select job, page, count(*) images, sum((x1 - x0) * (y1 - y0)) area from r where kind = 'figure_caption' group by job, page),
d as (select job, page, count(*) drawings, avg(case when x1 - x0 < 20 and y1 - y0 < 20 then 1 else 0 end) glyphs from r where kind = 'diagram_label' group by job, page), ch as (select job, page, count(*) chars from r where kind = 'paragraph' group by job, page)
select job, page, coalesce(images, 0) images, coalesce(drawings, 0) drawings, coalesce(chars, 0) chars, coalesce(area, 0) / 5000 image_area_ratio, coalesce(glyphs, 0) glyph_share,
case when coalesce(chars, 0) < 5 and coalesce(area, 0) / 5000 > 0.8 then 'scanned' when coalesce(chars, 0) < 5 and coalesce(drawings, 0) > 40 then 'vector_suspect' when coalesce(chars, 0) >= 5 then 'texty' else 'empty' end kind from p left join i using (job, page) left join d using (job, page) left join ch using (job, page)""")
def flt1_page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, FLT1, FLT2, AG23."""
    r = regions(spark, sf_dir)
    pages = r.select("job", "page").distinct().withColumn("box", rects.rect(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(100.0)))
    part = lambda k: r.filter(F.col("kind") == k)
    return vectors.page_inventory(pages, part("figure_caption"), part("diagram_label"), part("paragraph"))


@query("""with t as (select distinct unnest([split_part(text, ' ', 1), split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)]) term from benchmark), d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' low from documents)
select doc_id, term from d join t on contains(low, ' ' || trim(regexp_replace(lower(term), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ')""")
def jn19_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19 at word boundaries, by equality."""
    w = lambda k: F.split_part(F.col("text"), F.lit(" "), F.lit(k))
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.array(w(1), F.concat(w(2), F.lit(" "), w(3)))).alias("term"))
    return requests.term_hits(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


@query("""select doc_id, regexp_matches(text, '^\\s*[0-9]+([.][0-9]+)*[.\\s]\\s*\\S') heading_like, not regexp_matches(rtrim(replace(text, chr(10), ' ')), '[.:;!?…。][''"’”)\\]]?$') soft_end, contains(text, '....') contents from documents""")
def sc19_reading_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19, FLT10."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", R.heading_like(t).alias("heading_like"), R.soft_end(F.replace(t, F.lit("\n"), F.lit(" "))).alias("soft_end"), R.contents_line(t).alias("contents"))


@query("""select doc_id, list_reduce(list_prepend('x', list_filter(string_split(text, ' '), lambda w: w <> '')), lambda a, b: a)::varchar as mark, len(list_filter(string_split(text, ' '), lambda w: w <> '')) tokens from documents""".replace("list_reduce(list_prepend('x', list_filter(string_split(text, ' '), lambda w: w <> '')), lambda a, b: a)::varchar as mark, ", ""))
def sc25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(R.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("""with p as (select conv_id, turn, text source, lead(text) over (partition by conv_id order by turn) target from conversations), b as (select *, list_sort(regexp_extract_all(source, '[0-9]{2,}')) s, list_sort(regexp_extract_all(target, '[0-9]{2,}')) t from p)
select conv_id, turn, case when target is null then 'SCHEMA_INVALID' when trim(target) = '' then 'EMPTY_TARGET' when """ + " or ".join(f"(regexp_matches(target, '{p}') and not regexp_matches(source, '{p}'))" for _, p in T.ARTIFACTS) + """ then 'LLM_ARTIFACT'
when conv_id % 5 = 0 then 'UNKNOWN_ROLE' when conv_id % 7 = 0 then 'MISSING_STYLE_ROLE' when s <> t then 'PLACEHOLDER_MISMATCH' end reject from b""")
def gt10_first_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GT10: the exclusive rejects in order; numbers of two digits stand for placeholders, roles go by the conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").withColumn("target", F.lead("text").over(w))
    asked = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("body"), F.lit("label"))).otherwise(F.array(F.lit("body")))
    given = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("body"), F.lit("odd"))).otherwise(F.array(F.lit("body")))
    return p.select("conv_id", "turn", requests.first_reject(F.col("text"), F.col("target"), F.lit(True), asked, given, "[0-9]{2,}", 0).alias("reject"))


@query("""select doc_id job, case when quality is null then 1 else 0 end pending, case when quality = 1 and toxic = 1 then 1 else 0 end untranslated, case when quality = 0 then 1 else 0 end manual, quality is not null and not (quality = 1 and toxic = 1) and quality <> 0 passed from documents left join labels using (doc_id)""")
def gt1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    action = F.when(F.col("quality") == 1, "translate").when(F.col("quality") == 0, "manual")
    return gates.coverage(d.select(F.col("doc_id").alias("job"), action.alias("action"), F.when(F.col("toxic") == 0, "x").alias("target")))


@query(f"""with {REGIONS}, o as (select job, page, x0 - idx ox, x0, idx from r) select job, page, min(greatest(ox, x0)) base_x, greatest(min_by(ox, idx), min(x0)) paint_x from o group by job, page""")
def ft5_draw_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).select("job", "page", F.col("idx").alias("n"), (F.col("box.x0") - F.col("idx")).alias("origin"), F.col("box.x0").alias("ink"))
    return fit.draw_origin(r, ["job", "page"])


@query(f"""with {REGIONS} select job, id, case when size / 11 < 0.9::double then 'FONT_RATIO_HARD' when size / 11 < 0.95::double then 'FONT_RATIO_REVIEW' end code, greatest(3, floor((400 / size - length(text) * 0.5::double - 1) / 0.25::double))::int dots from r""")
def ft9_fit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT9, FT11."""
    r = regions(spark, sf_dir)
    dots = fit.dot_leaders(F.length("text") * 0.5, F.lit(1.0), F.col("size"), F.lit(400.0))
    return r.select("job", "id", fit.fit_issue(F.col("size"), F.lit(11.0)).alias("code"), dots.alias("dots"))


@query(f"""with {REGIONS}, k as (select *, case when kind = 'heading' then 'B' else 'R' end style from r), s as (select *, case when style <> lag(style) over (partition by job, page order by idx) then 1 else 0 end d from k),
g as (select *, 1 + sum(d) over (partition by job, page order by idx) run from s) select job, page, run::bigint run, string_agg(text, '' order by idx) as text, any_value(style) style from g group by job, page, run""")
def wn4_style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("kind") == "heading", "B").otherwise("R")
    return layout.style_runs(regions(spark, sf_dir).withColumn("n", F.col("idx")), ["job", "page"], style)


@query(f"""with {REGIONS} select job, page, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(*)::int n_lines, sha256(string_agg(text, chr(10) order by idx)) source_hash from r group by job, page""")
def rg3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RG3, AG1."""
    out = layout.regions_of(regions(spark, sf_dir).withColumn("n", F.col("idx")), ["job", "page"])
    return out.select("job", "page", "box.*", "n_lines", "source_hash")


@query(f"""with {REGIONS}, v as (select *, count(*) over (partition by x0) n0 from r where kind = 'table_cell'), t as (select x0, kind2, count(*) c from (select x0, case when n % 10 < 9 then 'left' else 'center' end kind2 from v) q group by all), g as (select x0, sum(c)::bigint total, min((-c, kind2)) top from t group by x0)
select x0, top[2] winner, -top[1] votes, total from g where total >= 4 and -top[1] >= 0.75 * total""")
def ag7_column_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7 at its own share of three quarters."""
    r = regions(spark, sf_dir).filter("kind = 'table_cell'").select(F.col("box.x0").alias("x0"), F.when(F.col("n") % 10 < 9, "left").otherwise("center").alias("vote"))
    return grouping.consensus(r, ["x0"], "vote")


# folds over a page, held to scenarios and brute force in the tests


@query()
def ag22_clustered_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clustered_rects(regions(spark, sf_dir).withColumn("n", F.col("idx")))


@query()
def ag6_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("n", F.col("idx"))
    return layout.alignment(r, ["job", "page"], rects.rect(F.lit(40.0), F.lit(0.0), F.lit(440.0), F.lit(280.0)))


@query()
def wn3_merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_paragraphs(regions(spark, sf_dir))


@query()
def rg2_label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).filter("kind in ('figure_caption', 'diagram_label')").withColumn("n", F.col("idx")).withColumn("text", F.left("text", F.lit(20)))
    return layout.label_clusters(r, ["job", "page"]).select("job", "page", "id", "cluster")


@query()
def jn6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    return layout.containers(r, r, rects.rect(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(300.0))).select("job", "page", "id", "container.*", "left_limit")


@query()
def ft7_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("movable", F.col("kind") != "table_cell").withColumn("centred", F.col("kind") == "figure_caption")
    return fit.expanded(r, r, 600.0)


@query()
def ft10_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    return gates.masks(r.filter("kind = 'paragraph'"), r.filter("kind = 'heading'")).select("job", "page", "id", "pad", "conflict")
