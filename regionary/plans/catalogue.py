"""Queries over the test tables, one per operator, and the same queries as DuckDB SQL.

Names begin with the operator's identifier in the survey. The tables hold no page regions, so each query puts its
operator on the nearest data: lines of documents, turns of conversations, intervals of events, votes of line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rects
from ..functions import text as T
from ..operators import fit, grouping, ordered, spatial, validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a source with the next turn as its target."""
    turns = ordered.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return turns.select("conv_id", "turn", F.col("text").alias("source"), F.col("next").alias("target")).filter("target is not null")


LINES = "lines as (select doc_id, source, n_chars, unnest(range(len(l))) line_no, unnest(l) line from (select *, string_split(text, chr(10)) l from documents))"
PAIRS = "pairs as (select conv_id, turn, text source, lead(text) over (partition by conv_id order by turn) target from conversations qualify lead(text) over (partition by conv_id order by turn) is not null)"
FOLDED = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"


@query(f"""with {LINES}, k as (select *, {FOLDED} as key from lines)
select key, count(*) members, min(doc_id) first_doc from k where length(key) between 3 and 80 group by key having count(*) >= 2""")
def ag10_same_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.shared_keys(lines(spark, sf_dir), T.fold_blanks(F.col("line")), ["doc_id", "line_no"])
    return found.select("key", "members", F.col("first.doc_id").alias("first_doc"))


@query(f"""with {LINES}, k as (select *, {FOLDED} as key from lines), g as (select key, count(*) members, min((n_chars, doc_id, line_no)) r from k where length(key) between 3 and 80 group by key having count(*) >= 2)
select key, members - 1 reused, r[2] rep_doc, r[3] rep_line from g""")
def ag11_reuse_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.shared_keys(lines(spark, sf_dir), T.fold_blanks(F.col("line")), ["n_chars", "doc_id", "line_no"])
    return found.select("key", (F.col("members") - 1).alias("reused"), F.col("first.doc_id").alias("rep_doc"), F.col("first.line_no").cast("long").alias("rep_line"))


@query(f"""with {LINES}, e as (select *, row_number() over (partition by doc_id order by line_no desc) back from lines),
k as (select source, substr(regexp_replace(trim(line), '[0-9]+', '#', 'g'), 1, 60) as key from e where line_no = 0 or back = 1), p as (select source, count(*) pages from documents group by source)
select source, key, count(*) seen from k join p using (source) group by source, key, pages having count(*) >= greatest(2, cast(floor(0.05 * pages) as int))""")
def ag9_repeated_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = F.split("text", "\n")
    edges = F.when(F.size(parts) > 1, F.array(F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(F.slice(parts, 1, 1))
    return grouping.repeated_edges(docs.select("source", F.explode(edges).alias("line")), T.digits_masked(F.col("line")), ["source"], docs.groupBy("source").agg(F.count("*").alias("pages")), share=0.05)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{{2,}}') t from documents)
select doc_id, case when len(t) >= 200 then greatest({', '.join(f"len(list_filter(t, lambda x: x in {_in(v)}))" for v in T.STOP_WORDS.values())})::double / len(t) end ratio from w""")
def ag13_stopword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.readable_ratio(F.col("text")).alias("ratio"))


@query(f"""with {PAIRS}, a as (select conv_id, turn, unnest(regexp_extract_all(source, '[0-9]+')) as value, 1 sign from pairs union all select conv_id, turn, unnest(regexp_extract_all(target, '[0-9]+')), -1 from pairs)
select conv_id, turn, value, sum(sign)::bigint excess from a group by all having sum(sign) <> 0""")
def ag12_digit_bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.bag_difference(pairs(spark, sf_dir), ["conv_id", "turn"], T.digit_runs(F.col("source")), T.digit_runs(F.col("target")))


def _count(c: str, s: str) -> str:
    return f"(length({c}) - length(replace({c}, '{s}', '')))"


@query(f"with {PAIRS} select conv_id, turn, ({' + '.join(f'abs({_count("source", s)} - {_count("target", s)})' for s in T.SYMBOLS)})::int drift from pairs")
def sc12_symbol_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", T.symbol_drift(F.col("source"), F.col("target")).cast("int").alias("drift"))


def _any(c: str, v) -> str:
    return f"regexp_matches(lower({c}), '(^|[^\\p{{L}}])({'|'.join(v)})([^\\p{{L}}]|$)')"


@query(f"with {PAIRS} select conv_id, turn, {_any('source', T.NEGATIONS)} and not {_any('target', T.TARGET_NEGATIONS)} dropped from pairs")
def sc13_negation_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", T.negation_drop(F.col("source"), F.col("target")).alias("dropped"))


@query(f"""with {PAIRS}, w as (select *, list_filter(regexp_extract_all(source, '[A-Za-z]{{3,}}'), lambda x: x = lower(x)) s, regexp_extract_all(target, '[A-Za-z]{{3,}}') t from pairs)
select conv_id, turn, len(list_filter(t, lambda x: list_contains(s, lower(x))))::int carried from w""")
def sc14_carry_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", T.carried_words(F.col("source"), F.col("target")).alias("carried"))


_STRIP = r"regexp_replace({}, 'https?://\S+|\S+@\S+', ' ', 'g')"
_FOLD = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
AUTHENTIC = f"""case when s < 4 then null when {_FOLD.format('source')} = {_FOLD.format('target')} then 'identical' when s >= 6 and t::double / s < 0.45 then 'truncated' when s >= 12 and t::double / s < 0.60 then 'truncated' end"""
COUNTED = f"c as (select *, len(regexp_extract_all({_STRIP.format('source')}, '\\p{{L}}{{3,}}')) s, len(regexp_extract_all({_STRIP.format('target')}, '\\p{{L}}{{3,}}')) t from pairs)"


@query(f"with {PAIRS}, {COUNTED} select conv_id, turn, {AUTHENTIC} verdict from c")
def sc10_authenticity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", T.authenticity(F.col("source"), F.col("target")).alias("verdict"))


ARTIFACT = "case " + " ".join(f"when regexp_matches(target, '{p}') and not regexp_matches(source, '{p}') then '{k}'" for k, p in T.ARTIFACTS) + " end"


@query(f"with {PAIRS} select conv_id, turn, {ARTIFACT} kind from pairs")
def sc16_artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", T.artifact(F.col("source"), F.col("target")).alias("kind"))


@query("select count(*) docs, 0::bigint broken from documents")
def sc7_mask_restore_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("text", T.mask(F.col("text")).alias("m"))
    return m.agg(F.count("*").alias("docs"), F.count_if(T.restore(F.col("m.masked"), F.col("m.tokens")) != F.col("text")).alias("broken"))


@query("""select doc_id, len(regexp_extract_all(text, '([a-z]+://|www[.])[^\\s⟦⟧]+'))::int urls from documents""")
def sc6_masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", T.mask(F.col("text"))["tokens"].alias("t"))
    return m.select("doc_id", F.size(F.filter(F.map_keys("t"), lambda k: k.startswith("URL_"))).alias("urls"))


@query("""with t as (select l_suppkey, l_returnflag w, count(*) n from lineitem group by all), g as (select l_suppkey, sum(n)::bigint total, min((-n, w)) top from t group by l_suppkey)
select l_suppkey, top[2] winner, -top[1] votes, total from g where total >= 4 and -top[1] >= 0.4 * total""")
def ag7_consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.consensus(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", share=0.4)


_TOP2 = "c as (select l_suppkey, l_quantity, count(*) n from lineitem group by all), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_quantity) as rank from c)"


@query(f"with {_TOP2} select l_suppkey, l_quantity, n, rank::int as rank from r where rank <= 2")
def st7_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top_two(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query(f"""with {_TOP2}, p as (select l_suppkey, max(case when rank = 1 then n end) na, max(case when rank = 2 then n end) nb, max(case when rank = 1 then l_quantity end) a, max(case when rank = 2 then l_quantity end) b from r group by all),
m as (select l_suppkey, quantile_cont(l_quantity, 0.5) middle from lineitem group by all) select l_suppkey, case when nb >= 0.8 * na then greatest(a, b) else middle end size from m join p using (l_suppkey)""")
def ag4_mode_or_median_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.mode_or_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("with a as (select user_id, count(*) over (partition by user_id order by value range between 1.0 preceding and 1.0 following) n from events) select user_id, max(n) agreeing from a group by user_id")
def ag5_agreement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.agreement(table(spark, sf_dir, "events"), ["user_id"], "value")


@query("""with a as (select *, epoch_us(ts) us from events), b as (select *, case when us - lag(us) over w > 3600000000 or abs(value - lag(value) over w) > 0.9 * greatest(value, lag(value) over w) then 1 else 0 end s from a window w as (partition by user_id order by us, event_id)),
c as (select user_id, sum(s) over (partition by user_id order by us, event_id) island from b) select user_id, count(distinct island) groups, count(*) as rows from c group by user_id""")
def wn2_gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    before = F.lag("value").over(w)
    e = e.withColumn("cut", (F.col("us") - F.lag("us").over(w) > 3600000000) | (F.abs(F.col("value") - before) > 0.9 * F.greatest("value", before)))
    return ordered.islands(e, ["user_id"], ["us", "event_id"], F.col("cut")).groupBy("user_id").agg(F.count_distinct("island").alias("groups"), F.count("*").alias("rows"))


_SPANS = "s as (select event_id, user_id, epoch_us(ts) lo, epoch_us(ts) + cast(floor(value * 60000000) as bigint) hi from events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", lo.alias("lo"), (lo + F.floor(F.col("value") * 60000000).cast("long")).alias("hi"))


@query(f"""with {_SPANS}, a as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) reach from s),
b as (select *, sum(case when reach is null or lo > reach + 60000000 then 1 else 0 end) over (partition by user_id order by lo, hi rows unbounded preceding) g from a)
select user_id, min(lo) lo, max(hi) hi, count(*) parts from b group by user_id, g""")
def wn10_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.merged_intervals(spans(spark, sf_dir), ["user_id"], "lo", "hi", gap=60000000)


@query(f"""with {LINES} select doc_id, line_no, last_value(case when length(line) < 25 then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) heading from lines""")
def wn5_last_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    return df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), ordered.last_heading(df, ["doc_id"], ["line_no"], F.length("line") < 25, F.col("line")).alias("heading"))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def wn14_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select conv_id, turn, lag(role) over w prev, lead(role) over w as next from conversations window w as (partition by conv_id order by turn)")
def jn12_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "prev", "next")


@query(f"with {_SPANS} select a.user_id, a.event_id a_id, b.event_id b_id from s a join s b on a.user_id = b.user_id and a.lo <= b.hi and b.lo <= a.hi and a.event_id < b.event_id")
def jn8_interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return spatial.interval_join(s, s, ["user_id"], "lo", "hi", 3.6e9).filter("a_event_id < b_event_id").select("user_id", F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query(f"""with {_SPANS}, p as (select event_id pid, user_id, lo + 30000000 p from s), j as (select p.user_id, pid, min((hi - lo, s.event_id)) b from p join s on s.user_id = p.user_id and p.p between s.lo and s.hi group by all)
select user_id, pid, b[2] event_id, b[1] size from j""")
def jn5_containment_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    points = s.select("user_id", F.col("event_id").alias("pid"), (F.col("lo") + 30000000).alias("p"))
    return spatial.tightest_container(points, s, ["user_id"], "p", "pid", "lo", "hi", "event_id", 3.6e9)


@query("""with r as (select event_id id, user_id, (event_id % 40)::double x0, (event_id % 17)::double y0, (event_id % 40) + value / 10 x1, (event_id % 17) + 1 + value / 20 y1 from events)
select a.user_id, a.id a_id, b.id b_id from r a join r b on a.user_id = b.user_id and a.id < b.id and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1""")
def jn8_rect_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") % 40).cast("double"), (F.col("event_id") % 17).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("value") / 10).alias("x1"), (y + 1 + F.col("value") / 20).alias("y1"))
    r = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), box.alias("box"))
    return spatial.rect_join(r, r, ["user_id"], 8.0).filter("a_id < b_id").select("user_id", "a_id", "b_id")


@query("with g as (select distinct split_part(p_name, ' ', 1) term from part) select g.term, count(*) docs from documents join g on instr(lower(text), g.term) > 0 group by g.term")
def jn19_glossary_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the glossary is a dimension of a few terms; Spark broadcasts it only below its size threshold
    terms = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("term")).distinct()
    return table(spark, sf_dir, "documents").select(F.lower("text").alias("low")).join(terms, F.col("low").contains(F.col("term"))).groupBy("term").agg(F.count("*").alias("docs"))


@query("select d.doc_id, l.quality, l.doc_id is null orphan from documents d left join labels l on d.doc_id = l.doc_id")
def jn1_orphan_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("id"), "left").select("doc_id", "quality", F.col("id").isNull().alias("orphan"))


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def jn2_pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(f"""with {LINES}, k as (select doc_id, {FOLDED} as key, n_chars from lines where line_no = 0), rep as (select key, min((n_chars, doc_id)) r from k group by key)
select k.doc_id, r[2] rep_doc, quality from k join rep using (key) left join labels l on l.doc_id = r[2] where k.doc_id <> r[2]""")
def jn3_reuse_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.fold_blanks(F.substring_index("text", "\n", 1)).alias("key"))
    rep = first.groupBy("key").agg(F.min(F.struct("n_chars", "doc_id")).alias("r")).select("key", F.col("r.doc_id").alias("rep_doc"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rep_doc"), "quality")
    return first.join(rep, "key").filter("doc_id <> rep_doc").join(labels, "rep_doc", "left").select("doc_id", "rep_doc", "quality")


@query("""with recursive f as (select conv_id, turn, role, length(text) n, lag(length(text)) over (partition by conv_id order by turn) p from conversations),
s as (select *, coalesce(n < p, false) linked from f), r as (select conv_id, turn, turn as head, 1 position from s where not linked union all select s.conv_id, s.turn, r.head, r.position + 1 from r join s on s.conv_id = r.conv_id and s.turn = r.turn + 1 and s.linked and r.position < 40),
l as (select *, count(*) over (partition by conv_id, head) length from r) select conv_id, turn, position::int as position, length from l where length >= 2""")
def gr2_chain_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").withColumn("linked", F.length("text") < F.lag(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")))
    return ordered.chains(c, ["conv_id"], ["turn"], F.col("linked")).select("conv_id", "turn", "position", "length")


@query("""with recursive o as (select source, doc_id, lang as page, (doc_id % 7 = 0) held, row_number() over (partition by source order by doc_id) n from documents),
r as (select source, doc_id, page, n, 0::bigint batch, 1 size from o where n = 1 union all
select o.source, o.doc_id, o.page, o.n, case when (o.page <> r.page or r.size >= 5) and not o.held then r.batch + 1 else r.batch end, case when (o.page <> r.page or r.size >= 5) and not o.held then 1 else r.size + 1 end from r join o on o.source = r.source and o.n = r.n + 1)
select source, doc_id, batch from r""")
def gr6_batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("page"), (F.col("doc_id") % 7 == 0).alias("held"))
    return ordered.batches(d, ["source"], ["doc_id"], "page", "held", most=5).select("source", "doc_id", "batch")


@query()
def ft1_greedy_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", fit.wrapped_lines(w, 60.0).cast("int").alias("lines"))


@query()
def ft2_binary_search_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = fit.largest_size()
    return table(spark, sf_dir, "documents").select("doc_id", size(F.col("text"), F.lit(400.0), F.lit(600.0)).alias("size"))


@query("select user_id, max(value + 1.5 * n) last from (select user_id, value, count(*) over (partition by user_id order by event_id desc rows between unbounded preceding and 1 preceding) n from events) t group by user_id")
def wn11_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last baseline over all events of a user."""
    return fit.last_baselines(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 1.5)


_DIGITS = "list_sort(regexp_extract_all(translate({}, '" + T.SUPERSCRIPTS[0] + "', '" + T.SUPERSCRIPTS[1] + "'), '[0-9]+'))"
_CARRIED = "len(list_filter(regexp_extract_all(target, '[A-Za-z]{3,}'), lambda x: list_contains(list_filter(regexp_extract_all(source, '[A-Za-z]{3,}'), lambda y: y = lower(y)), lower(x))))"
_MARKED = f"len(list_filter(string_split_regex(target, '\\s+'), lambda x: regexp_matches(x, '{T.MARKED_LETTERS}')))"
_RULES = f"""i as (select conv_id, turn, unnest(list_filter([case when ({AUTHENTIC}) = 'identical' then 'TRANSLATION_IDENTICAL/P1' end, case when ({AUTHENTIC}) = 'truncated' then 'TRANSLATION_TRUNCATED/P1' end, case when ({ARTIFACT}) is not null then 'LLM_ARTIFACT/P1' end,
case when {_DIGITS.format('source')} <> {_DIGITS.format('target')} then 'NUMBER_DRIFT/P1' end,
case when {_any('source', T.NEGATIONS)} and not {_any('target', T.TARGET_NEGATIONS)} then 'NEGATION_DROP/P1' end, case when {' + '.join(f'abs({_count("source", s)} - {_count("target", s)})' for s in T.SYMBOLS)} > 0 then 'SYMBOL_DRIFT/P1' end,
case when {_CARRIED} >= 3 and {_CARRIED} > 2 * greatest({_MARKED}, 0.5) then 'TRANSLATION_CARRY_THROUGH/P0' end], lambda x: x is not null)) c from c)"""
_SEVERITIES = "v as (select conv_id, count(*) filter (where c like '%P0') p0, count(*) filter (where c like '%P1') p1, count(*) filter (where c like '%P2') p2 from i group by conv_id)"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = validation.pair_rules(F.col("source"), F.col("target"))
    # the address rule needs look-around, which DuckDB lacks; it has tests of its own
    return validation.issues(pairs(spark, sf_dir), ["conv_id", "turn"], {k: v for k, v in rules.items() if k != "CONSISTENCY_ENTITY"})


@query(f"with {PAIRS}, {COUNTED}, {_RULES} select conv_id, turn, split_part(c, '/', 1) code, split_part(c, '/', 2) severity from i")
def gt10_pair_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"with {PAIRS}, {COUNTED}, {_RULES}, {_SEVERITIES} select * from v")
def ag15_severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.severity_counts(_issues(spark, sf_dir), ["conv_id"])


@query(f"with {PAIRS}, {COUNTED}, {_RULES}, {_SEVERITIES} select *, case when p0 = 0 and p1 = 0 then 'AUTO_QA_PASS' else 'NEEDS_REVIEW' end as result from v")
def gt8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.verdict(validation.severity_counts(_issues(spark, sf_dir), ["conv_id"]))


@query(f"""with {PAIRS}, {COUNTED}, {_RULES}, x as (select *, split_part(c, '/', 1) code, split_part(c, '/', 2) severity from i) select conv_id, turn, code, severity from x where severity = 'P0' or severity = 'P1' and not (conv_id % 2 = 0 and code = 'TRANSLATION_TRUNCATED')""")
def gt9_unwaived(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)
    waivers = table(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select("conv_id", F.lit("TRANSLATION_TRUNCATED").alias("code")).distinct()
    return validation.unwaived(found, waivers, ["conv_id"])


@query("""select source, avg(case when quality = 0 then 1 else 0 end) low, avg(case when toxic = 1 then 1 else 0 end) bad, greatest(avg(case when quality = 0 then 1 else 0 end), avg(case when toxic = 1 then 1 else 0 end)) <= 0.15 passed from documents join labels using (doc_id) group by source""")
def ag16_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return validation.ratio_gate(df, ["source"], {"low": F.col("quality") == 0, "bad": F.col("toxic") == 1}, 0.15)


@query("with s as (select user_id, event_type t, lag(event_type) over (partition by user_id order by ts, event_id) f from events) select f from_status, t to_status, count(*) steps from s where f is not null and f <> t and (f, t) not in (('view', 'click'), ('click', 'purchase')) group by all")
def status_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase")], "from_status string, to_status string")
    return ordered.illegal_steps(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", allowed).groupBy("from_status", "to_status").agg(F.count("*").alias("steps"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by round_even(l_extendedprice / 4000, 0), l_quantity, l_linenumber, l_partkey, l_suppkey) - 1 reading_index, l_partkey from lineitem")
def st1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy(*ordered.reading_order(F.col("l_extendedprice"), F.col("l_quantity"), 4000.0), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("reading_index"), "l_partkey")


@query("""with w as (select doc_id, string_split(lower(text), ' ') t from documents), g as (select distinct doc_id, unnest([array_to_string(t[i:i + 7], ' ') for i in range(1, len(t) - 6)]) as gram from w),
s as (select * from g where gram in (select gram from g group by gram having count(*) > 1)), k as (select doc_id, count(*) k from s group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) shared from s x join s y using (gram) where x.doc_id < y.doc_id group by all having count(*) >= 20),
e as (select a, b, shared, shared = ka.k and shared = kb.k same from p join k ka on a = ka.doc_id join k kb on b = kb.doc_id), later as (select distinct b from e where same)
select * from e where a not in (from later) and (same or b not in (from later))""")
def dup_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of documents that shares 20 grams of eight words or more, however common the grams are.

    Documents with the same shared grams form a class under its least id. Rows with ``same`` tie a class to each further
    member, the others pair the least ids of two classes; a pair of any members shares what its classes share.
    """
    return grouping.shared_grams(table(spark, sf_dir, "documents"), words=8, least=20)


def sql_query(name: str, spark_sql: str, tables: str, duck_sql: str | None = None) -> None:
    """A query whose SQL both engines run, as they are or with a DuckDB spelling of its own. Tables are named {like} {this}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    query((duck_sql or spark_sql).format(**{t: t for t in tables.split()}))(run)


sql_query("ag2_median_height", "select l_suppkey, coalesce(percentile(l_quantity, 0.5), 12.0) height from {lineitem} group by l_suppkey", "lineitem", "select l_suppkey, coalesce(quantile_cont(l_quantity, 0.5), 12.0) height from {lineitem} group by l_suppkey")
sql_query("ag3_weighted_median", "select l_suppkey, cast(percentile(l_discount, 0.5, cast(l_quantity as int)) as double) size from {lineitem} group by l_suppkey", "lineitem", "with w as (select l_suppkey, unnest(list_resize([l_discount], l_quantity::int, l_discount)) d from {lineitem}) select l_suppkey, quantile_cont(d, 0.5) size from w group by l_suppkey")
sql_query("ag14_font_usage", "select source, lang, sum(n_chars) chars, count(*) docs from {documents} group by source, lang", "documents", "select source, lang, sum(n_chars)::bigint chars, count(*) docs from {documents} group by source, lang")
sql_query("ag18_margins", "select l_suppkey, min(l_quantity) x0, max(l_extendedprice) x1 from {lineitem} where l_linenumber > 1 group by l_suppkey", "lineitem")
sql_query("flt2_share", "select user_id, avg(case when value < 20 then 1.0D else 0.0D end) share from {events} group by user_id", "events", "select user_id, avg(case when value < 20 then 1.0::double else 0.0::double end) share from {events} group by user_id")
sql_query("flt3_odd_kinds", "select distinct event_type from {events} where event_type not in ('view', 'click')", "events")
sql_query("flt4_document_class", "select source, case when max(case when lang = 'es' then 1 else 0 end) = 1 then 'REVIEW' when min(n_chars) < 100 then 'MANUAL' else 'SUPPORTED' end class from {documents} group by source", "documents")
sql_query("flt7_action", "select doc_id, case when trim(text) = '' then 'keep' when lang = 'en' then 'translate' else 'manual' end action from {documents}", "documents")
sql_query("jn11_set_anti", "select o_custkey from {orders} except select c_custkey from {customer} where c_acctbal < 0", "orders customer")
sql_query("set1_union_all", "select 'o' kind, o_custkey id from {orders} where o_totalprice > 400000 union all select 'c', c_custkey from {customer} where c_acctbal > 9000", "orders customer")
sql_query("set5_intersection", "select l_suppkey id from {lineitem} where l_quantity > 49 intersect select s_suppkey from {supplier}", "lineitem supplier")
sql_query("sc4_sha256", "select doc_id, sha2(text, 256) digest from {documents}", "documents", "select doc_id, sha256(text) digest from {documents}")
sql_query("sc22_length_guidance", "select event_id, cast(greatest(1, floor(value / (1.15 * 8))) as int) max_lines from {events}", "events")
sql_query("sc24_slices", "select doc_id, left(text, 24) head, right(text, 24) tail from {documents}", "documents")
sql_query("sc26_has_alnum", "select doc_id, text rlike '[0-9]' digits from {documents}", "documents", "select doc_id, regexp_matches(text, '[0-9]') digits from {documents}")
sql_query("wn1_reading_index", "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 idx from {conversations}", "conversations", "select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::int idx from {conversations}")
sql_query("wn7_header_context", "select l_orderkey, count(*) headers from (select l_orderkey, l_quantity, min(l_quantity) over (partition by l_orderkey) m from {lineitem}) t where l_quantity <= m + 3 group by l_orderkey", "lineitem")
sql_query("wn8_widest_gap", "select user_id, max(g) gap from (select user_id, value - max(value) over (partition by user_id order by value, event_id rows between unbounded preceding and 1 preceding) g from {events}) t group by user_id", "events")
sql_query("wn13_leading", "select user_id, coalesce(greatest(1.02, percentile(d, 0.5)), 1.15) ratio from (select user_id, value - lag(value) over (partition by user_id order by value, event_id) d from {events}) t where d > 0.1 group by user_id", "events", "select user_id, coalesce(greatest(1.02, quantile_cont(d, 0.5)), 1.15) ratio from (select user_id, value - lag(value) over (partition by user_id order by value, event_id) d from {events}) t where d > 0.1 group by user_id")
sql_query("gt1_coverage", "select source, count(*) - count(l.doc_id) pending, count(*) docs from {documents} d left join {labels} l on d.doc_id = l.doc_id group by source", "documents labels")


@query(f"""with f as (select conv_id, turn, role, {FOLDED.replace('line', 'text')} t from conversations), p as (select conv_id, turn, role, t, coalesce(lead(t) over (partition by conv_id order by turn), '') w from f),
o as (select p.conv_id, p.turn, p.role, p.t, p.w, coalesce(string_agg(f.t, ' ' order by f.turn), '') page from p left join f on f.conv_id = p.conv_id and f.turn <> p.turn group by all),
b as (select *, replace(t, ' ', '') bt, replace(page, ' ', '') bp from o)
select conv_id, turn, case when contains(w, t) then 'window' when contains(page, t) or contains(bp, bt) then 'page'
when role = 'user' and len(list_filter(list_distinct(string_split(bt, '')), lambda c: c <> '' and length(bt) - length(replace(bt, c, '')) > length(bp) - length(replace(bp, c, '')))) = 0 then 'reordered' else 'missing' end found from b""")
def gt3_turn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a target: the next turn is its window, the other turns of the conversation are its page, turns of users are kept."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.fold_blanks(F.col("text")).alias("t"))
    c = c.withColumn("w", F.coalesce(F.lead("t").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    rest = W.partitionBy("conv_id").orderBy("turn")
    before = F.collect_list("t").over(rest.rowsBetween(W.unboundedPreceding, -1))
    after = F.collect_list("t").over(rest.rowsBetween(1, W.unboundedFollowing))
    c = c.withColumn("page", F.array_join(F.concat(before, after), " "))
    return c.select("conv_id", "turn", T.coverage(F.col("t"), F.col("w"), F.col("page"), F.col("role") == "user").alias("found"))


@query("select event_id, greatest(0.0, value - 10) * greatest(0.0, 50 - value) area from events")
def sc20_rect_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = rects.rect(F.lit(10.0), F.col("value"), F.col("value"), F.lit(50.0))
    return table(spark, sf_dir, "events").select("event_id", rects.area(box).alias("area"))


@query("select event_id, ((event_id >> 16) & 255)::int r, ((event_id >> 8) & 255)::int g, (event_id & 255)::int b from events")
def sc21_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rects.unpack_colour(F.col("event_id").cast("int")).alias("c")).select("event_id", "c.*")


@query(f"""with {LINES}, k as (select *, {FOLDED} as key from lines where line_no = 0) select key, count(distinct lower(trim(source))) variants from k group by key having count(distinct lower(trim(source))) > 1""")
def ag17_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: first lines that come from more than one source."""
    first = table(spark, sf_dir, "documents").select("source", T.fold_blanks(F.substring_index("text", "\n", 1)).alias("key"))
    return grouping.variants(first, ["key"], F.lower(F.trim("source")))
