"""Registered queries over the flat tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from . import authoring
from .operators import blocks as B
from .operators import markup as M
from .operators import records as R
from .operators import sequence as S
from .plans.compiler import compile_recipe
from .sources.books import nodes
from .sources.tables import PAGE_BLOCK, document_lines, line_documents, page_blocks, page_documents, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The white-space class in the oracle's dialect.
_WS = "[" + T.WS_CLASS.replace("\\x09", "\\x{09}").replace("\\x0D", "\\x{0D}").replace("\\x1C", "\\x{1C}").replace("\\x20", "\\x{20}") + "]"


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


_PB = f"""raw as (select page_id, url, unnest(regexp_extract_all(html, '{PAGE_BLOCK}', 0)) as raw, unnest(range(1, len(regexp_extract_all(html, '{PAGE_BLOCK}', 0)) + 1)) as seq from pages),
pb as (select page_id, url, cast(seq as bigint) as seq, regexp_extract(raw, '^<(h[1-6]|p|li|pre)', 1) as tag, raw,
  regexp_replace(regexp_replace(raw, '<br(?:\\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') as text from raw)"""
_DL = "dl as (select doc_id, source, lang, cast(unnest(range(0, len(string_split(text, chr(10))))) as bigint) as seq, unnest(string_split(text, chr(10))) as text from documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _plain(c: str = "text"):
    return F.trim(T.collapse(F.col(c)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(read(spark, sf_dir, "documents"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(read(spark, sf_dir, "pages"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents with node tables."""
    return page_documents(read(spark, sf_dir, "pages"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all pages, empty ones too: (book_id, document_path, page_id, seq, tag, classes, text)."""
    found = B.candidates(nodes(_pages(spark, sf_dir)))
    by = [*B.DOC, "root"]
    texts = B.flatten(found.where("root is not null"), by)
    roots = found.where("is_root").select(*B.DOC, F.col("pre").alias("root"), F.col("sib").cast("long").alias("seq"), "tag", "classes")
    return roots.join(texts, by).select("book_id", "document_path", F.col("book_id").cast("long").alias("page_id"), "seq", "tag", "classes", F.col("raw").alias("text"))


_KIND = "case when tag like 'h%' then 'heading' when tag = 'li' then 'item' when tag = 'pre' then 'verbatim' else 'paragraph' end"


@query(f"""with {_PB}, n as (select page_id, seq, {_KIND} as type, {_norm('text')} as text from pb)
select printf('%d.%03d', page_id, row_number() over (partition by page_id order by seq)) as id, type, text from n where text <> ''""")
def extract_page_records(spark, sf_dir):
    """Page blocks as (id, type, text): normalised, empty ones dropped, numbered inside their page."""
    b = B.blocks(_pages(spark, sf_dir), form="none").select(F.col("book_id").cast("long").alias("page_id"), "seq", F.expr(_KIND).alias("type"), "text")
    numbered = S.number(b.withColumn("role", F.lit("block")), ["page_id"], ["seq"])
    return numbered.select(T.render("{group}.{number:03d}", {"group": F.col("page_id"), "number": F.col("block_no")}).alias("id"), "type", "text")


@query(f"with {_PB} select page_id, seq, tag, text from pb")
def scan_page_blocks(spark, sf_dir):
    return _scanned(spark, sf_dir).select("page_id", "seq", "tag", "text")


@query(f"with {_PB} select page_id, seq, tag from pb where tag in ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'pre') and {_norm('text')} <> ''")
def candidate_filter(spark, sf_dir):
    """Primary blocks alone, without those that have no text."""
    found = B.candidates(nodes(_pages(spark, sf_dir)), fallback=())
    texts = B.flatten(found.where("root is not null"), [*B.DOC, "root"]).where(~T.blank(F.col("raw")))
    kept = found.where("is_root").withColumn("root", F.col("pre")).join(texts, [*B.DOC, "root"], "left_semi")
    return kept.select(F.col("book_id").cast("long").alias("page_id"), F.col("sib").cast("long").alias("seq"), "tag")


@query("""select page_id, url from pages where regexp_matches(lower(url), '^https://.*/en/.*$') and not regexp_matches(lower(url), '^.*[.]html$')""")
def spine_select_glob(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(T.glob_any(F.col("url"), ["HTTPS://*/en/*"]) & ~T.glob_any(F.col("url"), ["*.html"]))


@query(f"with {_PB} select page_id, seq, tag from pb where not (seq = 1 or (seq >= 10 and seq % 10 = 1)) and page_id % 10 <> 3")
def exclude_locators(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("locator", F.concat(F.col("page_id").cast("string"), F.lit("#"), F.col("seq").cast("string")))
    return b.where(T.glob_any(F.col("locator"), ["*[!3]#*"]) & ~T.glob_any(F.col("locator"), ["*#1", "*#*1"])).select("page_id", "seq", "tag")


@query(f"with {_DL} select doc_id, seq, {_norm('text')} as text from dl where {_norm('text')} <> ''")
def normalize_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "seq", _plain().alias("text")).where("text <> ''")


@query(f"select doc_id, nfc_normalize({_norm('text')}) as text from documents")
def nfc_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))


@query(f"select conv_id, string_agg({_norm('text')}, ' ' order by turn) as text from conversations group by conv_id")
def flatten_join_text(spark, sf_dir):
    """Ordered join of the normalised turns of each conversation."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", _plain().alias("t")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("text"))


@query(f"with n as (select doc_id, {_norm('text')} as t from documents) select doc_id, substring(t, 12, 40) as text, cast(length(t) as bigint) as points from n where length(t) > 11")
def fragment_slice(spark, sf_dir):
    """Code points [11, 51) of each normalised document."""
    n = read(spark, sf_dir, "documents").select("doc_id", _plain().alias("t")).where(F.length("t") > 11)
    return n.select("doc_id", F.substring("t", 12, 40).alias("text"), F.length("t").cast("long").alias("points"))


@query(f"""with {_DL}, n as (select doc_id, seq, {_norm('text')} as t from dl)
select doc_id, seq, substring(t, length(regexp_extract(t, '^(?:[A-Za-z]+ )', 0)) + 1) as text from n where length(regexp_extract(t, '^(?:[A-Za-z]+ )', 0)) > 0""")
def remove_prefix(spark, sf_dir):
    n = _lines(spark, sf_dir).select("doc_id", "seq", _plain().alias("t"))
    n = n.withColumn("k", T.prefix_length(F.col("t"), "^[A-Za-z]+ ")).where("k is not null")
    return n.select("doc_id", "seq", F.col("t").substr(F.col("k") + 1, F.length("t")).alias("text"))


@query("""with n as (select page_id, regexp_extract(url, '/([0-9]+)(?:[/?#.]|$)', 1) as c from pages)
select page_id, case when length(cast(cast(c as bigint) as varchar)) >= 5 then cast(cast(c as bigint) as varchar) else lpad(cast(cast(c as bigint) as varchar), 5, '0') end as grp from n where c <> '' and cast(c as bigint) >= 1""")
def group_source_pattern(spark, sf_dir):
    """Group captured from the URL, decimal, five digits."""
    c = S.pattern_capture(F.col("url"), "/([0-9]+)(?:[/?#.]|$)")
    p = read(spark, sf_dir, "pages").select("page_id", T.convert_capture(c, "decimal", width=5).alias("grp"))
    return p.where("grp is not null")


@query("""select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as grp from events""")
def group_marker_ffill(spark, sf_dir):
    """Events carry the latest signup of their user."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return e.select("event_id", "user_id", S.fill_forward(marker, ["user_id"], ["ts", "event_id"]).alias("grp"))


@query("""select doc_id, source, last_value(case lang when 'fr' then 'french' when 'de' then 'german' end ignore nulls) over (partition by source order by doc_id rows between unbounded preceding and current row) as grp from documents""")
def group_transitions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    g = S.transition_groups(F.col("lang"), {"fr": "french", "de": "german"})
    return d.select("doc_id", "source", S.fill_forward(g, ["source"], ["doc_id"]).alias("grp"))


@query("select doc_id, case lang when 'en' then '01' when 'fr' then '02' when 'de' then '03' end as grp from documents")
def capture_map(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.convert_capture(F.col("lang"), mapping={"en": "01", "fr": "02", "de": "03"}).alias("grp"))


@query("""with d as (select doc_id, cast(regexp_extract(source, '([0-9]+)$', 1) as int) as n from documents)
select doc_id, list_extract(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX'], n % 20 + 1) as numeral, printf('%03d', n % 20 + 1) as grp from d""")
def capture_roman(spark, sf_dir):
    """Roman chapter numbers of sources converted to padded decimals."""
    names = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    d = read(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), n % 20 + 1).alias("numeral"))
    return d.select("doc_id", "numeral", T.convert_capture(F.lower("numeral"), "roman", width=3).alias("grp"))


_ROLES = "case role when 'user' then 'line-start' when 'assistant' then 'line' else 'block' end"
_NUMBERED = f"""r as (select conv_id, turn, {_ROLES} as role from conversations),
n as (select *, sum(case when role in ('block', 'line-start') then 1 else 0 end) over (partition by conv_id order by turn) as block_no from r),
k as (select *, first_value(role) over (partition by conv_id, block_no order by turn) as head,
  sum(case when role in ('line-start', 'line') then 1 else 0 end) over (partition by conv_id, block_no order by turn) as line_no from n)"""


def _numbered(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ROLES).alias("role"))
    return S.number(c, ["conv_id"], ["turn"])


@query(f"with {_NUMBERED} select conv_id, turn, printf('%d.%03d', conv_id, block_no::bigint) as id from k where role = 'block'")
def ids_block(spark, sf_dir):
    n = _numbered(spark, sf_dir).where("role = 'block'")
    return n.select("conv_id", "turn", T.render("{group}.{number:03d}", {"group": F.col("conv_id"), "number": F.col("block_no")}).alias("id"))


@query(f"with {_NUMBERED} select conv_id, turn, printf('%d.%03d.%02d', conv_id, block_no::bigint, line_no::bigint) as id from k where role = 'line-start' or (role = 'line' and block_no > 0 and head = 'line-start')")
def ids_line(spark, sf_dir):
    n = _numbered(spark, sf_dir).where("line_no is not null")
    return n.select("conv_id", "turn", T.render("{group}.{block:03d}.{number:02d}", {"group": F.col("conv_id"), "block": F.col("block_no"), "number": F.col("line_no")}).alias("id"))


@query(f"with {_PB} select page_id, seq, 'p' || page_id || '.1.' || seq as id from pb")
def ids_fixed_path(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("path", F.concat(F.lit("1."), F.col("seq").cast("string")))
    return b.select("page_id", "seq", T.render("p{group}.{element_path}", {"group": F.col("page_id"), "element_path": F.col("path")}).alias("id"))


@query("""select conv_id, turn, case when role = 'user' and regexp_matches(text, '[?]') then 0 when role in ('user', 'system') then 1 when regexp_matches(text, '(?i)^the ') then 2 else -1 end as rule from conversations""")
def rules_first_match(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("classes", F.array("role"))
    tests = [R.match({"classes": ["user"], "text_pattern": r"[?]"}), R.match({"classes_any": ["user", "system"]}), R.match({"text_pattern": "^the ", "case_insensitive": True})]
    return c.select("conv_id", "turn", R.first_match(tests).alias("rule"))


@query(f"with {_DL} select doc_id, seq, text from dl where not (seq = 0 and lang = 'en')")
def skip_source(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("locator", F.concat("lang", F.lit("#"), F.col("seq").cast("string")))
    return R.skip(d, ["en#0"]).select("doc_id", "seq", "text")


@query(f"""with {_DL} select doc_id, seq, part, case part when 0 then text when 1 then substring(text, 1, 5) else substring(text, 6, 7) end as text
from dl join (values (0), (1), (2)) v(part) on (seq = 0) = (part > 0)""")
def replacement_split(spark, sf_dir):
    """The first line of each document becomes two slices."""
    slices = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 5, 12)], "seq long, part int, start int, stop int")
    return R.replace_by_slices(_lines(spark, sf_dir).select("doc_id", "seq", "text"), slices, "seq", "seq").select("doc_id", "seq", "part", "text")


@query(f"with {_DL} select doc_id, seq, 0 as place, text from dl union all select doc_id, seq, 1, 'note' from dl where seq = 1")
def insertion_after(spark, sf_dir):
    notes = spark.createDataFrame([(1, "note", 1)], "seq long, text string, place int")
    return R.insert_after(_lines(spark, sf_dir).select("doc_id", "seq", "text"), notes, "seq").select("doc_id", "seq", "place", "text")


@query(f"""with recursive {_DL}, t as (select doc_id, seq, case when length(text) < 60 then 2 else 1 end as n, max(seq) over (partition by doc_id) as final from dl),
r as (select doc_id, seq as first, n, final from t where seq = 0
  union all select t.doc_id, t.seq, t.n, t.final from r join t on t.doc_id = r.doc_id and t.seq = r.first + r.n)
select doc_id, first, least(first + n - 1, final) as last, least(first + n - 1, final) - first + 1 as members, first + n - 1 <= final as complete from r""")
def consume_fixed(spark, sf_dir):
    """A short line takes the next line with it, greedily."""
    keys = _lines(spark, sf_dir).select("doc_id", "seq", F.when(F.length("text") < 60, 2).otherwise(1).alias("takes"), F.lit(-1).alias("rule"), F.array(F.lit(False)).alias("goes_on"), F.lit(False).alias("breaks"), F.lit(False).alias("ends_after"))
    found = S.runs(keys, "doc_id", "seq").join(keys.select("doc_id", F.col("seq").alias("run"), "takes"), ["doc_id", "run"])
    return found.groupBy("doc_id", F.col("run").alias("first")).agg(F.max("seq").alias("last"), F.count("*").alias("members"), (F.count("*") == F.max("takes")).alias("complete"))


@query("""with e as (select event_id, user_id, ts, event_type in ('view', 'click') as go from events),
i as (select *, sum(case when go then 0 else 1 end) over (partition by user_id order by ts, event_id) as isl from e),
h as (select *, not go or max(event_id) over (partition by user_id, isl order by ts, event_id rows between unbounded preceding and 1 preceding) is null as head from i)
select event_id, user_id, last_value(case when head then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from h""")
def consume_while(spark, sf_dir):
    """Views and clicks continue the run of the event before them."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.array(F.col("event_type").isin("view", "click")).alias("goes_on"))
    placed = S.runs(e.select("user_id", "seq", F.lit(0).alias("takes"), F.lit(0).alias("rule"), "goes_on", F.lit(False).alias("breaks"), F.lit(False).alias("ends_after")), "user_id", "seq")
    heads = e.select("user_id", F.col("seq").alias("run"), F.col("event_id").alias("head"))
    return e.join(placed, ["user_id", "seq"]).join(heads, ["user_id", "run"]).select("event_id", "user_id", F.col("head").alias("run"))


@query(f"""with {_PB}, li as (select page_id, seq, case when regexp_matches(text, '^[A-Z]') then cast(length(text) as bigint) end as v from pb where tag = 'li'),
s as (select *, count(v) over (partition by page_id order by seq) as seg, last_value(v ignore nulls) over (partition by page_id order by seq rows between unbounded preceding and current row) as base from li)
select page_id, seq, cast(coalesce(base, 1) + row_number() over (partition by page_id, seg order by seq) - 1 as bigint) as ordinal from s""")
def list_ordinal(spark, sf_dir):
    """Numbers of list items; capitalised ones restart the count at their length."""
    li = _blocks(spark, sf_dir).where("tag = 'li'").select("page_id", "seq", F.when(F.col("text").rlike("^[A-Z]"), F.length("text")).alias("v"))
    return S.list_ordinals(li, ["page_id"], ["seq"], "v", F.lit(None).cast("int"), F.lit(False)).select("page_id", "seq", "ordinal")


@query(f"with {_PB}, l as (select page_id, seq, tag, lag(tag) over (partition by page_id order by seq) as prev from pb) select page_id, seq from l where tag = 'p' and prev = 'h1'")
def prev_sibling(spark, sf_dir):
    found = B.with_selectors(nodes(_pages(spark, sf_dir)), {"hit": {"tag": "P", "previous_sibling": {"tag": "h1"}}})
    return found.where("hit").select(F.col("book_id").cast("long").alias("page_id"), F.col("sib").cast("long").alias("seq"))


@query(f"with {_PB} select page_id, seq, tag from pb where exists (select 1 from pb q where q.page_id = pb.page_id and q.tag = 'h1') and tag = 'li'")
def has_primary_descendant(spark, sf_dir):
    """List items of pages whose body has a heading as a child."""
    n = B.with_selectors(nodes(_pages(spark, sf_dir)), {"hit": {"tag": "body", "has_child": {"tag": "h1"}}, "item": {"tag": "li"}})
    items = n.where("item").select("book_id", F.col("sib").cast("long").alias("seq"), "tag")
    return items.join(n.where("hit").select("book_id"), "book_id", "left_semi").select(F.col("book_id").cast("long").alias("page_id"), "seq", "tag")


@query("""with e as (select user_id, event_id as k from events where event_type = 'error'), a as (select user_id, event_id as k from events where event_type <> 'error')
select e.user_id, e.k as event, coalesce(min(a.k) filter (where a.k >= e.k), max(a.k)) as anchor, min(a.k) filter (where a.k >= e.k) is null as trailing
from e left join a using (user_id) group by e.user_id, e.k""")
def asof_attach_next(spark, sf_dir):
    """Errors go to the user's next other event, the last ones to the last."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("k"), "event_type")
    errors = e.where("event_type = 'error'").withColumn("event", F.col("k"))
    others = e.where("event_type <> 'error'").withColumn("anchor", F.col("k"))
    return S.attach_next(errors, others, "user_id", "k", "event", "anchor").select("user_id", "event", "anchor", "trailing")


@query("select md5(text) as key, count(*) as rows from documents group by all having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return R.repeated_keys(read(spark, sf_dir, "documents").select(F.md5("text").alias("key")), "key")


@query("""with s as (select user_id, event_id, event_id as start, event_id + cast(floor(value) as bigint) as stop from events),
m as (select *, max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from s)
select user_id, event_id from m where reach > start""")
def fragment_reuse_check(spark, sf_dir):
    s = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value").cast("long")).alias("stop"))
    return R.overlapping_slices(s, ["user_id"]).select("user_id", "event_id")


@query(f"with {_DL} select doc_id, count(*) as lines, count(distinct text) as texts from dl group by doc_id having count(*) > count(distinct text)")
def locator_cardinality(spark, sf_dir):
    """Documents in which a line stands more than once."""
    d = _lines(spark, sf_dir).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return d.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count("*").alias("texts")).where("lines > texts")


@query(f"with {_PB} select tag, count(*) as blocks, count(distinct page_id) as pages from pb group by tag")
def pattern_profile(spark, sf_dir):
    """Patterns by tag alone."""
    p = authoring.profile(_scanned(spark, sf_dir).withColumn("classes", F.array().cast("array<string>")))
    return p.select("tag", "blocks", F.col("documents").alias("pages"))


@query(f"""with {_PB}, n as (select page_id, seq, tag, row_number() over (partition by page_id, tag order by seq) as a, row_number() over (partition by page_id, tag order by seq desc) as z from pb)
select page_id, seq, tag from n where a <= 3 or z <= 3""")
def pattern_examples(spark, sf_dir):
    """The first and last three blocks of each pattern of a page."""
    return authoring.examples(_scanned(spark, sf_dir)).select("page_id", "seq", "tag")


@query(f"with {_PB} select p.page_id, count(b.seq) as blocks from pages p left join pb b using (page_id) group by p.page_id")
def blocks_per_document(spark, sf_dir):
    counts = authoring.blocks_per_document(_pages(spark, sf_dir), _scanned(spark, sf_dir))
    return counts.select(F.col("book_id").cast("long").alias("page_id"), "blocks")


@query(f"""with {_DL} select doc_id, seq, '<line label="' || seq || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') || '</line>' as text from dl""")
def render_xml(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "seq", F.concat(F.lit('<line label="'), F.col("seq").cast("string"), F.lit('">'), R.escape_xml(F.col("text")), F.lit("</line>")).alias("text"))


@query(rf"with {_DL} select doc_id, seq, '[' || regexp_replace(text, '([\[\]*\\])', '\\\1', 'g') || ']' as text from dl")
def render_delimiters(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "seq", F.concat(F.lit("["), R.escape_delimiters(F.col("text"), ["[", "]", "*"]), F.lit("]")).alias("text"))


@query(f"with {_PB} select page_id, seq, regexp_replace(regexp_replace(raw, '</?(?:b|strong)(?:\\s[^>]*)?>', '*', 'g'), '<[^>]*>', '', 'g') as text from pb where regexp_matches(raw, '<(?:b|strong)[ >]')")
def render_literal(spark, sf_dir):
    """Bold text between stars, other tags removed."""
    b = _blocks(spark, sf_dir).where(F.col("raw").rlike("<(?:b|strong)[ >]"))
    return b.select("page_id", "seq", F.regexp_replace(F.regexp_replace("raw", r"</?(?:b|strong)(?:\s[^>]*)?>", "*"), "<[^>]*>", "").alias("text"))


@query(f"with {_PB} select page_id, seq, regexp_extract(raw, 'href=\"/([^\"]*)\"', 1) as label from pb where regexp_matches(raw, 'href=\"/[^\"]+\"')")
def milestone_labels(spark, sf_dir):
    """Labels that milestones take from an attribute, a fixed prefix removed."""
    rule = {"match": {"tag": "a", "attribute_prefixes": {"href": "/"}}, "kind": "milestone", "name": "a", "label_attribute": "href", "label_strip_prefix": "/", "label_text": False, "label_counter": None, "position": "replace", "continue_matching": False, "preserve_whitespace": False}
    marked = M.with_marks(nodes(_pages(spark, sf_dir)), [rule], B.DOC).where((F.size("marks") > 0) & F.col("mark_fault").isNull())
    return marked.select(F.col("book_id").cast("long").alias("page_id"), F.col("path")[0].cast("long").alias("seq"), F.col("marks")[0]["label"].alias("label"))


@query("""with a as (select doc_id, text, strpos(text, 'the ') as p from documents),
o as (select *, p > 0 and (p = 0 or strpos(substr(text, p + 1), 'the ') = 0) as ok from a)
select doc_id, case when ok then substr(text, 1, p - 1) || 'THE ' || substr(text, p + 4) else text end as text, ok as errata_ok from o""")
def errata_exact_once(spark, sf_dir):
    """An edit that must occur exactly once in each document."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    edits = d.select("doc_id", F.lit(1).alias("ord"), F.lit("the ").alias("find"), F.lit("THE ").alias("replacement"))
    return R.apply_errata(d, edits, "doc_id").select("doc_id", "text", "errata_ok")


@query(f"with {_DL} select doc_id || '.' || seq || chr(9) || coalesce(lang, '') || chr(9) || {_norm('text')} as line from dl where {_norm('text')} <> ''")
def tsv_line(spark, sf_dir):
    d = _lines(spark, sf_dir).select(F.concat_ws(".", F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), _plain().alias("text")).where("text <> ''")
    return d.select(R.tsv_line("id", "lang", "text").alias("line"))


@query("select doc_id from documents where regexp_matches(text, '[\\t\\r\\n]')")
def tsv_violations(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(R.unsafe_for_tsv(F.col("text"))).select("doc_id")


@query("select page_id, sha256(html) as sha256 from pages")
def source_sha256(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


_COVER = f"regexp_replace(regexp_replace(html, '{PAGE_BLOCK}', '', 'g'), '<(?:script|style|title)[^>]*>[^<]*|<[^>]*>', '', 'g')"


@query(f"select page_id, cast(length({_norm(_COVER)}) as bigint) as left_over from pages where {_norm(_COVER)} <> ''")
def strict_coverage(spark, sf_dir):
    """Text of pages that no block and no deliberate exclusion covers."""
    found = B.candidates(nodes(_pages(spark, sf_dir)))
    left = B.uncovered(found).select("book_id", "element_path")
    own = F.concat(F.when(F.col("root").isNull(), F.coalesce("txt", F.lit(""))).otherwise(F.lit("")), F.coalesce("tail", F.lit("")))
    parts = found.join(left, ["book_id", "element_path"], "left_semi").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pre", own.alias("t")))).alias("x"))
    p = parts.select(F.col("book_id").cast("long").alias("page_id"), T.strip(T.collapse(F.array_join(F.transform("x", lambda x: x["t"]), ""))).alias("t")).where("t <> ''")
    return p.select("page_id", F.length("t").cast("long").alias("left_over"))


_RECIPE = {"recipe_version": "1", "epub": {"sha256": "0" * 64}, "normalization": {"unicode_normalization": "none"}}
_FRONT = {"document": "d", "element_path": "1"}


@query(f"""with {_DL}, n as (select doc_id, seq, {_norm('text')} as t from dl), l as (select * from n where t <> ''),
g as (select *, count(case when regexp_matches(t, '^[A-Z]') then 1 end) over (partition by doc_id order by seq) as run from l),
r as (select doc_id, case when run = 0 then seq else 1000000000 + run end as k, min(seq) as first, string_agg(t, ' ' order by seq) as text, run > 0 as sentence from g group by all)
select doc_id, case when sentence then 'sentence' else 'rest' end as type, printf('%04d', 1 + row_number() over (partition by doc_id order by first)) as id, text from r
union all select doc_id, 'heading', '0001', 'Document ' || doc_id from documents where text is not null""")
def recipe_joins(spark, sf_dir):
    """A whole recipe over the lines of all documents: a line with a capital takes the lines without one that follow."""
    output = {
        "identifiers": {"block": {"template": "{number:04d}"}}, "default": {"type": "rest"},
        "rules": [{"match": {"tag": "h1"}, "type": "heading"}, {"match": {"text_pattern": "^[A-Z]"}, "type": "sentence", "consume_while": {"text_pattern": "^[^A-Z]"}}],
    }
    records = compile_recipe(line_documents(read(spark, sf_dir, "documents")), _RECIPE | {"output": output}, pin=False, keep=False).records()
    return records.select(F.col("book_id").cast("long").alias("doc_id"), "type", "id", "text")


@query(f"""with {_DL}, l as (select doc_id, seq, {_norm('text')} as t from dl where seq > 0)
select doc_id, 'line' as type, printf('front.%03d', seq + 2) as id, t as text from l
union all select doc_id, 'name', 'front.001', 'Paper' from documents where text is not null
union all select doc_id, 'digit', 'front.002', substring(doc_id::varchar, 1, 1) from documents where text is not null
union all select doc_id, 'note', 'front:1', 'Document ' || doc_id || '/' || substring(doc_id::varchar, 1, 1) from documents where text is not null""")
def recipe_edits(spark, sf_dir):
    """A whole recipe over the lines of all documents: the heading is replaced by two slices and a joined note follows
    it, the first line is skipped, empty lines are kept, groups come from a transition, and an erratum is applied."""
    piece = lambda a, b: _FRONT | {"slice": {"start": a, "end": b}}
    recipe = _RECIPE | {
        "source_blocks": {"element_rules": [{"match": {"tag": "p"}, "action": "block", "keep_empty": True}]},
        "errata": [{"id": "front.001", "find": "Document", "replace": "Paper"}],
        "output": {
            "groups": {"transitions": {"d#1": "front"}}, "identifiers": {"block": {"template": "{group}.{number:03d}"}}, "default": {"type": "line", "allow_empty": True}, "skip_source": ["d#2"],
            "replacements": [{"anchor": "d#1", "outputs": [{"type": "name", "parts": [piece(0, 8)]}, {"type": "digit", "parts": [piece(9, 10)]}]}],
            "insertions": [{"after": "d#1", "outputs": [{"type": "note", "role": "fixed", "id": "{group}:{element_path}", "separator": "/", "parts": [_FRONT, piece(9, 10)]}]}],
        },
    }
    records = compile_recipe(line_documents(read(spark, sf_dir, "documents")), recipe, pin=False).records()
    return records.select(F.col("book_id").cast("long").alias("doc_id"), "type", "id", "text")


@query(f"""with {_PB}, n as (select page_id, seq, tag, raw, {_norm('text')} as t from pb where {_norm('text')} <> '')
select page_id, printf('%03d', row_number() over (partition by page_id order by seq)) as id,
  case when regexp_matches(raw, '^<li[^>]*><a ') then '[' || t || ']' || t when regexp_matches(raw, '^<p[^>]*><b>') then '*' || t || '*' else t end as text from n""")
def recipe_markup(spark, sf_dir):
    """A whole recipe over all pages: links are milestones labelled by their text, bold text is a span between stars."""
    rules = [
        {"match": {"tag": "a"}, "kind": "milestone", "name": "link", "label_text": True, "position": "before"},
        {"match": {"tag": "b"}, "kind": "span", "name": "bold"},
    ]
    markup = {"format": "literal", "rules": rules, "delimiters": {"link": ["[", "]"], "bold": ["*", "*"]}, "between_blocks": "ignore", "trailing": "ignore"}
    output = {"identifiers": {"block": {"template": "{number:03d}"}}, "default": {"type": "block"}}
    records = compile_recipe(_pages(spark, sf_dir), _RECIPE | {"text": {"markup": markup}, "output": output}, pin=False).records()
    return records.select(F.col("book_id").cast("long").alias("page_id"), "id", "text")


@query(f"""with {_DL}, n as (select doc_id, seq, case when (seq + 2) % 5 = 0 then '' else {_norm('text')} end as t from dl union all select doc_id, -1, 'Document ' || doc_id from documents where text is not null),
k as (select *, count(case when t <> '' then 1 end) over (partition by doc_id order by seq desc) as k from n),
b as (select *, sum((t = '')::int) over (partition by doc_id, k) as marks, sum((k = 0)::int) over (partition by doc_id) as rest from k)
select doc_id, printf('%04d', row_number() over (partition by doc_id order by seq)) as id, repeat('~', marks::int) || t || case when k = 1 then repeat('~', rest::int) else '' end as text from b where t <> ''""")
def recipe_milestones(spark, sf_dir):
    """A whole recipe over the lines of all documents with milestones between blocks: an empty line, and each line whose
    place ends in 0 or 5, becomes a mark on the next line with text; those after the last one go to its end."""
    rules = [{"match": {"locators": ["d#*[05]"]}, "kind": "milestone", "name": "mark"}, {"match": {"tag": "p", "empty": True}, "kind": "milestone", "name": "mark"}]
    markup = {"format": "literal", "rules": rules, "delimiters": {"mark": ["~", ""]}, "between_blocks": "next", "trailing": "previous"}
    output = {"identifiers": {"block": {"template": "{number:04d}"}}, "default": {"type": "line"}}
    records = compile_recipe(line_documents(read(spark, sf_dir, "documents")), _RECIPE | {"text": {"markup": markup}, "output": output}, pin=False, keep=False).records()
    return records.select(F.col("book_id").cast("long").alias("doc_id"), "id", "text")
