"""Registered queries of site maps, sources and sinks, policies, entities and edits by hand, over rows made from small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..operators import entities, sitemap, spans, terms
from ..operators.redact import redact
from ..policy import Masking, Policy, Term
from ..scratch import shared_dir
from ..sources.files import read_items, read_texts, write_json, write_text
from .cases import _join
from .queries import SECRET, SQL, _capitals, _email, _items, _pair, _secret, _table, _BENCH_WORDS, _COMPARE, _LABEL, query

_N = "cast(n_nationkey as string)"
_MAIL = _join("n", f"={_N}", "@corp-mail.com")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"


# sources and sinks


@query
def q_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation, read whole, masked, written as text and read by line."""
    texts = _table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("\nmail "), F.expr(_MAIL)).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(at := _scratch(spark, "texts"))
    write_text(redact(read_texts(spark, at)), out := _scratch(spark, "masked"))
    return spark.read.text(out).select(F.col("value").alias("line"))


SQL["q_text_files"] = f"select unnest([n_name, 'mail ' || {_email(_MAIL)}, '']) line from nation"


@query
def q_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts as JSON, without originals, read back."""
    texts = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("mail "), F.expr(_MAIL)).alias("text"))
    write_json(redact(texts), at := _scratch(spark, "json"))
    back = spark.read.json(at)
    return back.select("n_nationkey", "output", F.size("findings").alias("n_findings"), F.lit(",".join(back.columns)).alias("fields"), F.array_join(F.sort_array(F.map_keys(F.from_json(F.to_json(F.get("findings", F.lit(0))), "map<string,string>"))), ",").alias("of_finding"))


SQL["q_json_sink"] = f"select n_nationkey, 'mail ' || {_email(_MAIL)} output, 1::int n_findings, 'findings,format,n_nationkey,output' fields, 'category,end,replacement,start' of_finding from nation"


@query
def q_xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an XML export: attributes, CDATA, entities, encoded messages, one of five of them broken."""
    n = _table(spark, sf_dir, "nation").select(F.expr(_N).alias("k"), F.col("n_name").alias("name"))
    encoded = F.when(F.col("k").cast("int") % 5 == 0, F.lit("no base64!")).otherwise(F.base64(F.encode(F.concat(F.lit("GET /n/"), "k"), "UTF-8")))
    item = F.concat(
        F.lit('<item><host ip="10.0.0.1">h'), "k", F.lit(".example.com</host><port>443</port><protocol>https</protocol><method><![CDATA[GET]]></method><path><![CDATA[/n/"), "k", F.lit("?a=1&b=2]]></path><extension>null</extension><request base64=\"true\"><![CDATA["),
        encoded, F.lit(']]></request><status>200</status><mimetype>a &amp; b</mimetype><response base64="false"><![CDATA[plain '), "name", F.lit("]]></response></item>"),
    )
    whole = n.agg(F.concat(F.lit('<?xml version="1.0"?>\n<items burpVersion="1">\n'), F.array_join(F.array_sort(F.collect_list(item)), "\n"), F.lit("\n</items>")).alias("value"))
    whole.write.text(at := _scratch(spark, "xml"))
    return read_items(spark, at).select("host", "port", "path", "status", "mimetype", F.decode("request", "UTF-8").alias("request"), F.decode("response", "UTF-8").alias("response"))


SQL["q_xml_items"] = f"""select 'h' || {_N} || '.example.com' host, '443' port, '/n/' || {_N} || '?a=1&b=2' as path, '200' status, 'a & b' mimetype,
case when n_nationkey % 5 = 0 then '' else 'GET /n/' || {_N} end request, 'plain ' || n_name response from nation"""


# site maps


@query
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.sections(_pair(spark, sf_dir))


_CLASSES = ", ".join(f"('{c}', {k + 1})" for k, c in enumerate(sitemap.CLASSES))
SQL["q_sections"] = f"""select c.class, c.p::int as "position", count(r.class) total from (values {_CLASSES}) c(class, p) left join {_COMPARE} r on r.class = c.class group by 1, 2"""


@query
def q_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's table of classes, from its text."""
    text = sitemap.report(_pair(spark, sf_dir), _items(spark, sf_dir, 0), _items(spark, sf_dir, 1), labels=("high", "low"))
    lines = [x for x in text.split("\n") if x.startswith("| ") and x.count("|") == 3 and not x.startswith("| Result")][: len(sitemap.CLASSES)]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, lines))).alias("line"))


_TITLES = ", ".join("('" + c + "', '" + t[0].replace("'", "''") + "')" for c, t in sitemap._titles("high", "low").items())
SQL["q_report_summary"] = f"""select '| ' || t.title || ' | ' || count(r.class) || ' |' line from (values {_TITLES}) t(class, title) left join {_COMPARE} r on r.class = t.class group by t.title"""

_NOTE = """(case when class = 'same_content' and identical then 'identical body' when class = 'same_content' then 'same once ids and tokens are ignored'
  when class = 'different_content' and contains(path, '{') and not same_object then 'different objects, so some difference is expected' else '' end)"""


@query
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of answers without fields; ``q_key_notes`` has those with."""
    return _pair(spark, sf_dir).select("origin", sitemap.label().alias("label"), "class", sitemap.notes().alias("notes"))


SQL["q_notes"] = f"select origin, {_LABEL} as label, class, {_NOTE} notes from {_COMPARE}"


@query
def q_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.matching(_pair(spark, sf_dir), "EN").select("origin", sitemap.label().alias("label"))


SQL["q_row_filter"] = f"select origin, {_LABEL} as label from {_COMPARE} where contains(lower({_LABEL} || ' ' || {_NOTE}), 'en')"


def _supplied(spark: SparkSession, sf_dir: str, low: bool) -> DataFrame:
    """Items whose bodies have keys of their own: three endpoints, all suppliers or a fourth of them."""
    s = _table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 4 == 0 if low else F.lit(True))
    name = F.concat(F.lit("k"), (F.col("s_suppkey") % 500).cast("string"))
    body = F.concat(F.lit('{"'), name, F.lit('": {"v": 1}, "all": [{"id": 2}]'), F.lit(', "z1": 0}' if low else "}"))
    raw = s.select(
        F.lit("api.corp-mail.com").alias("host"), F.lit("443").alias("port"), F.lit("https").alias("protocol"), F.lit("get").alias("method"), F.concat(F.lit("/s/"), F.substring(F.lit("abc"), (F.col("s_suppkey") % 3 + 1).cast("int"), F.lit(1))).alias("path"),
        F.lit("200").alias("status"), F.lit("JSON").alias("mimetype"), F.lit("null").alias("extension"), F.lit(b"").alias("request"), F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n"), body), "UTF-8").alias("response"),
    )
    return sitemap.items(raw)


@query
def q_key_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sitemap.compare(sitemap.endpoint_stats(_supplied(spark, sf_dir, False)), sitemap.endpoint_stats(_supplied(spark, sf_dir, True)))
    return rows.select(sitemap.label().alias("label"), "class", sitemap.notes().alias("notes"))


SQL["q_key_notes"] = """
with h as (select s_suppkey % 3 g, unnest(['all', 'all[].id', 'k' || s_suppkey % 500, 'k' || s_suppkey % 500 || '.v']) k from supplier),
l as (select s_suppkey % 3 g, unnest(['all', 'all[].id', 'k' || s_suppkey % 500, 'k' || s_suppkey % 500 || '.v', 'z1']) k from supplier where s_suppkey % 4 = 0),
more as (select g, list_sort(list(distinct k)) ks from h where (g, k) not in (select (g, k) from l) group by g)
select 'GET /s/' || 'abc'[g + 1] as label, 'different_content' as class,
  array_to_string(list_transform(ks[:12], lambda x: '+' || x), ' ') || case when len(ks) > 12 then ' and ' || (len(ks) - 12) || ' more' else '' end || '; -z1' notes from more"""


def _nation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\nmail "), F.expr(_MAIL), F.lit(" "), F.when(F.col("n_nationkey") == 1, F.lit("\0")).otherwise(""), F.repeat(F.lit("x"), F.lit(3000)))
    raw = n.select(
        F.lit("api.corp-mail.com").alias("host"), F.lit("443").alias("port"), F.lit("https").alias("protocol"), F.lit("get").alias("method"), F.concat(F.lit("/n/"), "n_name").alias("path"),
        F.lit("200").alias("status"), F.lit("HTML").alias("mimetype"), F.lit("null").alias("extension"), F.lit(b"").alias("request"), F.encode(body, "UTF-8").alias("response"),
    )
    return sitemap.items(raw)


@query
def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.samples(_nation_items(spark, sf_dir), "high", "/n/", most=3).select("role", "endpoint", "text")


SQL["q_samples"] = f"""select 'high' as role, 'GET /n/' || n_name endpoint, left('HTTP/1.1 200 OK' || chr(13) || chr(10) || chr(13) || chr(10) || 'mail ' || {_email(_MAIL)} || ' ' || repeat('x', 3000), 2048) as text
from nation where n_nationkey <> 1 order by n_name limit 3"""


@query
def q_masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of names, masked alone; placeholders stay, cells are escaped."""
    pieces = _table(spark, sf_dir, "nation").select(F.explode(F.array(F.expr(_MAIL), F.concat(F.lit("plain"), F.expr(_N)), F.lit("{id}"), F.concat(F.lit("a|b`"), F.expr(_N)))).alias("piece"))
    return sitemap.masked_pieces(pieces, Policy())


SQL["q_masked_names"] = f"""select {_MAIL} piece, {_email(_MAIL)} masked from nation union all select 'plain' || {_N}, 'plain' || {_N} from nation union all select '{{id}}', '{{id}}' union all select 'a|b`' || {_N}, 'a\\|b''' || {_N} from nation"""

# policies and terms

_BASE, _TOP = Policy(name="base", client=("Acme",), users=("ann",), masking=Masking(secret_keep=0.5)), Policy(name="top", client=("Globex",), terms=(Term("x", "[X]"),), masking=Masking(id_cut=0.9))


@query
def q_policy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers, written and read back as TOML: lists add up, name and masking are the upper ones."""
    p = Policy.from_toml(Policy.from_toml(_BASE.to_toml()).layered(Policy.from_toml(_TOP.to_toml())).to_toml())
    rows = [("name", p.name), *(("client", c) for c in p.client), *(("users", u) for u in p.users), *(("terms", f"{t.value}={t.replacement}") for t in p.terms), *((f, str(getattr(p.ratios, f))) for f in ("id_cut", "secret_keep", "pii_keep"))]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("field"), F.lit(b).alias("value")) for a, b in rows))))


SQL["q_policy_layers"] = "select * from (values ('name', 'top'), ('client', 'Acme'), ('client', 'Globex'), ('users', 'ann'), ('terms', 'x=[X]'), ('id_cut', '0.9'), ('secret_keep', '0.3'), ('pii_keep', '0.4')) t(field, value)"


@query
def q_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.listed(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "#00000000")


SQL["q_term_filter"] = "select c_name as value from customer where contains(lower(c_name), '#00000000')"

# entities


@query
def q_entity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses line by line, with the stand-in for the model; one request is no JSON, one is blank."""
    asked = _table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("text", F.array(F.lit("person")).alias("labels"))).alias("request"))
    asked = asked.unionByName(spark.range(1).select(F.explode(F.array(F.lit("no json"), F.lit(" "))).alias("request")))
    said = entities.served(asked, _capitals)
    found = F.from_json(F.get_json_object("response", "$.entities"), "array<struct<start:int,end:int,label:string,score:double>>")
    rows = said.select(F.col("response").contains('"error"').alias("error"), found.alias("e"))
    each = rows.select("error", F.coalesce(F.size("e"), F.lit(-1)).alias("n"), F.coalesce(F.aggregate("e", F.lit(0).cast("long"), lambda t, x: t + x.end - x.start), F.lit(0)).alias("chars"))
    return each.groupBy("error", "n", "chars").agg(F.count("*").alias("times"))


SQL["q_entity_lines"] = f"""with f as (select item_id, count(*)::int n, sum(len("match"))::bigint chars from {_BENCH_WORDS} where i % 2 = 1 and regexp_matches("match", '^\\p{{Lu}}') group by 1),
r as (select false error, coalesce(n, 0)::int n, coalesce(chars, 0)::bigint chars from benchmark left join f using (item_id) union all select true, -1::int, 0::bigint)
select error, n, chars, count(*) times from r group by 1, 2, 3"""

# edits by hand

_F = "array<struct<start:int,end:int,category:string,replacement:string>>"


@query
def q_resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps: the higher priority, then the longer, the earlier and the smaller replacement; empty ones go."""
    o = "cast(n_nationkey % 7 as int)"

    def found(*spans_: tuple[int, int, str, str]) -> F.Column:
        return F.expr("array(" + ", ".join(f"named_struct('start', {o} + {a}, 'end', {o} + {b}, 'category', '{c}', 'replacement', '{r}')" for a, b, c, r in spans_) + ")").cast(_F)

    cases = {
        "priority": found((0, 9, "host", "a"), (2, 4, "email", "b")), "longer": found((0, 3, "id", "a"), (1, 9, "id", "b")), "earlier": found((3, 6, "id", "a"), (1, 4, "id", "b")), "smaller": found((0, 3, "id", "b"), (0, 3, "id", "a")),
        "chain": found((0, 4, "email", "a"), (3, 7, "host", "b"), (6, 9, "email", "c")), "freed": found((0, 9, "id", "a"), (0, 5, "email", "b"), (5, 9, "pii", "c")), "empty": found((4, 4, "email", "a"), (4, 5, "id", "b")),
    }
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), f.alias("found")) for n, f in cases.items()))))
    kept = F.transform(spans.resolve("found"), lambda x: F.concat(x.start.cast("string"), F.lit("-"), x.end.cast("string"), F.lit(":"), x.replacement))
    return rows.select("n_nationkey", "name", F.array_join(kept, " ").alias("kept"))


def _spans_sql(*kept: tuple[int, int, str]) -> str:
    return " || ' ' || ".join(f"(n_nationkey % 7 + {a}) || '-' || (n_nationkey % 7 + {b}) || ':{r}'" for a, b, r in kept)


_KEPT = {"priority": [(2, 4, "b")], "longer": [(1, 9, "b")], "earlier": [(1, 4, "b")], "smaller": [(0, 3, "a")], "chain": [(0, 4, "a"), (6, 9, "c")], "freed": [(0, 5, "b"), (5, 9, "c")], "empty": [(4, 5, "b")]}
SQL["q_resolve_cases"] = " union all ".join(f"select n_nationkey, '{n}' as name, {_spans_sql(*k)} kept from nation" for n, k in _KEPT.items())


@query
def q_merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a model join the findings only where the text is plain, the later first."""
    o = "cast(n_nationkey % 7 as int)"

    def of(*rows: tuple[int, int, str]) -> F.Column:
        return F.expr("array(" + ", ".join(f"named_struct('start', {o} + {a}, 'end', {o} + {b}, 'category', 'pii', 'replacement', '{r}')" for a, b, r in rows) + ")").cast(_F)

    both = spans.merged(of((5, 20, "E")), of((0, 4, "P1"), (3, 8, "P2"), (21, 24, "P3"), (22, 30, "P4"), (20, 21, "P5")))
    shown = F.transform(both, lambda x: F.concat(x.start.cast("string"), F.lit("-"), x.end.cast("string"), F.lit(":"), x.replacement))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(shown, " ").alias("kept"))


SQL["q_merged_findings"] = f"select n_nationkey, {_spans_sql((0, 4, 'P1'), (5, 20, 'E'), (20, 21, 'P5'), (22, 30, 'P4'))} kept from nation"


@query
def q_masked_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection in a plain segment, trimmed and masked; a blank one changes nothing."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("hello "), "c_name", F.lit(" bye")).alias("text"))
    parts = spans.segments("text", F.array().cast(_F))
    end = F.char_length("text") - 3
    by_hand = spans.masked_by_hand(parts, F.lit(0), F.lit(5), end, lambda x: masks.secret(x, SECRET))
    blank = spans.masked_by_hand(parts, F.lit(0), F.lit(5), F.lit(6), lambda x: masks.secret(x, SECRET))
    join = lambda p, f: F.array_join(F.transform(p, f), "|")
    return c.select("c_custkey", join(by_hand, lambda s: s.text).alias("masked"), join(by_hand, lambda s: s.original).alias("original"), join(by_hand, lambda s: s.kind).alias("kinds"), F.size(blank).alias("n_blank"), spans.utf16_offset(F.concat(F.lit("😀é"), "text"), F.lit(3)).alias("utf16"))


SQL["q_masked_by_hand"] = f"select c_custkey, 'hello |' || {_secret('c_name')} || '| bye' masked, 'hello |' || c_name || '| bye' original, 'plain|masked|plain' kinds, 1::int n_blank, 4::int utf16 from customer"
