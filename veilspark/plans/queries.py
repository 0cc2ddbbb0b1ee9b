"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import masks
from ..functions.formats import detect_format
from ..operators import entities, sitemap, spans, vault
from ..operators.redact import findings, most_frequent, redact, summary
from ..policy import Policy, Term
from ..scratch import materialise, shared_dir

QUERIES = {}
SQL = {}
KEEP, CUT, SECRET = 0.4, 0.2, 0.3
#: Made of words that the documents hold, so that each kind of term has hits.
TERMS = Policy(client=("tion the",), users=("the of",), hosts=("onthe",), terms=(Term("and the", "[X]"), Term("of")))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL building blocks: matches between two marks, as spans.scan has them


def _matches(table: str, key: str, text: str, pattern: str, group: int = 0, before: str = "", after: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"""(select {key}, i, cast(coalesce(sum(len(p)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as int) as "start", p as "match", t
      from (select {key}, t, unnest(ps) p, unnest(range(len(ps))) i from (select {key}, {text} t, string_split_regex(regexp_replace({text}, '{quoted}', '{before}' || chr(1) || '\\{group}' || chr(2) || '{after}', 'g'), '[\\x01\\x02]') ps from {table})))"""


def _keep_head(x: str, keep: float = KEEP) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda w: case when regexp_matches(w, '[\p{{L}}\p{{N}}]') then
      left(w, least(ceil(len(w) * {keep}::double)::int, len(w) - 1)) || repeat('*', len(w) - least(ceil(len(w) * {keep}::double)::int, len(w) - 1)) else w end), '')"""


def _cut_tail(x: str, cut: float = CUT) -> str:
    n = rf"len(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    hide = f"least(greatest(ceil({n} * {cut}::double)::int, 1), {n})"
    return rf"""(case when {n} = 0 then {x} else array_to_string(list_transform(range(1, len({x}) + 1), lambda k: case when regexp_matches({x}[k], '[\p{{L}}\p{{N}}]')
      and len(regexp_replace({x}[k:], '[^\p{{L}}\p{{N}}]', '', 'g')) <= {hide} then '*' else {x}[k] end), '') end)"""


def _card(x: str) -> str:
    total = f"len(regexp_replace({x}, '[^0-9]', '', 'g'))"
    seen = f"len(regexp_replace({x}[:k], '[^0-9]', '', 'g'))"
    return f"array_to_string(list_transform(range(1, len({x}) + 1), lambda k: case when regexp_matches({x}[k], '[0-9]') and {seen} > 4 and {seen} <= {total} - 4 then '*' else {x}[k] end), '')"


def _luhn(x: str) -> str:
    d = f"reverse(regexp_replace({x}, '[^0-9]', '', 'g'))"
    one = f"{d}[k]::int"
    return f"(len({d}) between 13 and 19 and list_sum(list_transform(range(1, len({d}) + 1), lambda k: case when k % 2 = 1 then {one} when {one} > 4 then 2 * {one} - 9 else 2 * {one} end)) % 10 = 0)"


def _ipv4(x: str) -> str:
    a, b = f"split_part({x}, '.', 1)", f"split_part({x}, '.', 2)"
    private = f"({a} in ('10', '127') or {a} || '.' || {b} in ('192.168', '169.254') or ({a} = '172' and {b}::int between 16 and 31) or ({a} = '100' and {b}::int between 64 and 127))"
    return f"(case when {private} then {a} || '.' || {b} || '.*.*' else {a} || '.*.*.*' end)"


_ALLOWED = "(" + "|".join(d.replace(".", r"\.") for d in tables.ALLOWED_DOMAINS) + ")"


def _host(x: str) -> str:
    two = f"lower(array_to_string(string_split({x}, '.')[-2:], '.'))"
    n = f"len(string_split({x}, '.'))"
    listed = ", ".join(f"'{s}'" for s in tables.SECOND_LEVEL)
    own = f"({n} - (case when {n} = 1 then 0 when {two} in ({listed}) then least(2, {n} - 1) else 1 end))"
    return f"(case when regexp_matches(lower({x}), '(^|\\.){_ALLOWED}$') then {x} else array_to_string(list_transform(string_split({x}, '.'), lambda y, k: case when k = {own} then {_keep_head('y')} else y end), '.') end)"


def _email(x: str) -> str:
    return f"({_keep_head(f'''split_part({x}, '@', 1)''')} || '@' || {_host(f'''split_part({x}, '@', 2)''')})"


def _rows(df: DataFrame, key: str, text: str, found) -> DataFrame:
    return df.select(key, text, F.explode(found).alias("m")).select(key, text, "m.start", "m.end", "m.match")


# detectors


@query
def q_email_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_at = _table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    rows = _rows(with_at, "doc_id", "text", spans.scan("text", tables.EMAIL))
    return rows.select("doc_id", "start", "end", "match", masks.mask_email("match", KEEP).alias("masked"))


SQL["q_email_findings"] = f"""select doc_id, "start", cast("start" + len("match") as int) "end", "match", {_email('"match"')} masked from {_matches("documents", "doc_id", "text", tables.EMAIL)} where i % 2 = 1"""


@query
def q_ipv4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = _table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\.\d"))
    rows = _rows(dotted, "doc_id", "text", spans.scan("text", tables.IPV4))
    before, before2, after = spans.char_before("text", F.col("start")), spans.char_before("text", F.col("start") - 1), spans.char_at("text", F.col("end"))
    ok = (before != ".") & (after != ".") & ((before != "/") | (before2 == "/")) & ~F.col("match").isin("0.0.0.0", "127.0.0.1", "255.255.255.255")
    return rows.where(ok).select("doc_id", "start", "end", "match", masks.ipv4("match").alias("masked"))


SQL["q_ipv4_findings"] = f"""select doc_id, "start", cast("start" + len("match") as int) "end", "match", {_ipv4('"match"')} masked from {_matches("documents", "doc_id", "text", tables.IPV4)}
where i % 2 = 1 and (case when "start" > 0 then t["start"] else '' end) <> '.' and t["start" + len("match") + 1] <> '.' and ((case when "start" > 0 then t["start"] else '' end) <> '/' or (case when "start" > 1 then t["start" - 1] else '' end) = '/')
and "match" not in ('0.0.0.0', '127.0.0.1', '255.255.255.255')"""


@query
def q_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_digits = _table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d[ -]?\d"))
    rows = _rows(with_digits, "doc_id", "text", spans.scan("text", tables.CARD))
    return rows.select("doc_id", "start", "match", masks.luhn_valid("match").alias("valid"), masks.card("match").alias("masked"))


SQL["q_card_luhn"] = f"""select doc_id, "start", "match", {_luhn('"match"')} valid, {_card('"match"')} masked from {_matches("documents", "doc_id", "text", tables.CARD)} where i % 2 = 1"""


@query
def q_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(_table(spark, sf_dir, "pages"), "page_id", "url", spans.scan("url", tables.PATH_ID, 1, before="/"))
    before, after, after2 = spans.char_before("url", F.col("start") - 1), spans.char_at("url", F.col("end")), spans.char_at("url", F.col("end") + 1)
    return rows.where(~before.rlike("[0-9]") & ~((after == ".") & after2.rlike("[A-Za-z0-9]"))).select("page_id", "start", "match", masks.cut_tail("match", CUT).alias("masked"))


SQL["q_path_ids"] = f"""select page_id, "start", "match", {_cut_tail('"match"')} masked from {_matches("pages", "page_id", "url", tables.PATH_ID, 1, before="/")}
where i % 2 = 1 and not regexp_matches(t["start" - 1], '[0-9]') and not regexp_matches(t["start" + len("match") + 1:], '^\\.[A-Za-z0-9]')"""


@query
def q_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no allowed domains, so that the pages' hosts are masked."""
    pages = _table(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit(tables.DOMAIN), F.lit(0))).alias("host"))
    known = F.lower(F.substring_index("host", ".", -1)).isin(tables.TLDS)
    return rows.where(known).select("page_id", "host", masks.mask_host("host", KEEP, ()).alias("masked"), masks.mask_host("host", KEEP).alias("allowed"))


_OPEN_HOST = _host("host").split("else array_to_string(list_transform(string_split(host", 1)[1]
SQL["q_hosts"] = f"""select page_id, host, array_to_string(list_transform(string_split(host{_OPEN_HOST[:-5]} masked, {_host("host")} allowed
from (select page_id, unnest(regexp_extract_all(url, '{tables.DOMAIN}')) host from pages) where lower(split_part(host, '.', -1)) in ({", ".join(f"'{t}'" for t in tables.TLDS)})"""

_PARAM = tables.PARAM.replace("'", "''")


@query
def q_query_params_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    keys = pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit(tables.PARAM), F.lit(1))).alias("key"))
    return keys.select("page_id", "key", F.coalesce(masks.classify_key("key", True), F.lit("none")).alias("kind"))


def _class(k: str, is_param: bool) -> str:
    n = f"lower(regexp_replace({k}, '[^A-Za-z0-9]', '', 'g'))"
    secret = ", ".join(f"'{x}'" for x in [*tables.SECRET_KEYS, *(tables.SECRET_PARAMS if is_param else [])])
    pii = ", ".join(f"'{x}'" for x in tables.PII_KEYS)
    part = f"(regexp_matches({n}, '{'|'.join(tables.SECRET_KEY_PARTS)}') and not regexp_matches({n}, '({'|'.join(tables.METADATA_SUFFIXES)})$'))"
    return f"""coalesce(case when {n} = '' then null when {n} in ({secret}) or {part} then 'secret'
      when regexp_matches(lower({k}), '^(id|uid|uuid|guid)$|[_.-]id$') or (len({k}) > 2 and regexp_matches({k}, '(Id|ID)$')) then 'id' when {n} in ({pii}) then 'pii' end, 'none')"""


SQL["q_query_params_classified"] = f"""select page_id, "key", {_class('"key"', True)} kind from (select page_id, unnest(regexp_extract_all(url, '{_PARAM}', 1)) "key" from pages)"""

_KEYS = ["id", "user_id", "userId", "paid", "newPassword", "token_type", "client_secret", "code", "e-mail", "Full Name", "expires_in", "session", "X.id", "guid", "valid", "dob", ""]


@query
def q_classify_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, _KEYS))).alias("key"))
    return keys.select("key", masks.normalize_key("key").alias("normal"), F.coalesce(masks.classify_key("key"), F.lit("none")).alias("kind"), masks.is_id_key("key").alias("is_id"), masks.slugify("key").alias("slug"), masks.valid_name("key").alias("is_name"))


SQL["q_classify_keys"] = f"""select "key", lower(regexp_replace("key", '[^A-Za-z0-9]', '', 'g')) normal, {_class('"key"', False)} kind,
regexp_matches(lower("key"), '^(id|uid|uuid|guid)$|[_.-]id$') or (len("key") > 2 and regexp_matches("key", '(Id|ID)$')) is_id,
coalesce(nullif(regexp_replace(regexp_replace(lower("key"), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'engagement') slug, regexp_matches("key", '^[A-Za-z0-9_-][A-Za-z0-9._-]{{0,63}}$') is_name
from (select unnest([{", ".join(f"'{k}'" for k in _KEYS)}]) "key")"""


@query
def q_json_number_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    pairs = events.select("event_id", F.explode(F.arrays_zip(F.regexp_extract_all("props", F.lit(tables.JSON_NUMBER_PAIR), F.lit(1)).alias("key"), F.regexp_extract_all("props", F.lit(tables.JSON_NUMBER_PAIR), F.lit(2)).alias("num"))).alias("p"))
    return pairs.select("event_id", "p.key", "p.num", masks.cut_tail("p.num", CUT).alias("masked"))


SQL["q_json_number_pairs"] = f"""select event_id, k as "key", num, {_cut_tail("num")} masked from (select event_id, unnest(regexp_extract_all(props, '{tables.JSON_NUMBER_PAIR}', 1)) k, unnest(regexp_extract_all(props, '{tables.JSON_NUMBER_PAIR}', 2)) num from events)"""


@query
def q_mask_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    ip = F.concat_ws(".", F.lit("172"), (F.col("c_custkey") % 40).cast("string"), F.lit("3"), F.lit("9"))
    key = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey", masks.cut_tail("c_name", CUT).alias("cut"), masks.keep_head("c_name", KEEP).alias("kept"), masks.secret("c_name", SECRET).alias("secret"), masks.secret(key, SECRET).alias("short_secret"),
        masks.ipv4(ip).alias("ip"), masks.ipv6(F.concat(key, F.lit("::1f"))).alias("ip6"), masks.fold(F.concat("c_name", F.lit(" ÁÑÜ"))).alias("folded"), masks.slugify("c_name").alias("slug"),
    )


def _secret(x: str) -> str:
    return f"(left({x}, case when len({x}) < 7 then 0 else least(floor(len({x}) * {SECRET}::double)::int, 12) end) || '…[len=' || len({x}) || ']')"


SQL["q_mask_scalars"] = f"""select c_custkey, {_cut_tail("c_name")} cut, {_keep_head("c_name")} kept, {_secret("c_name")} secret, {_secret("k")} short_secret, {_ipv4("ip")} ip, k || '::*' ip6, lower(c_name) || ' anu' folded,
regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug from (select *, c_custkey::varchar k, '172.' || (c_custkey % 40) || '.3.9' ip from customer)"""


@query
def q_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ["GET /a HTTP/1.1\r\nHost: x", "HTTP/1.1 200 OK", "curl -u a:b https://x", 'fetch("x")', '{"log": {"entries": []}}', '<items burpVersion="1"/>', '{"info": {"_postman_id": "1"}}', "  await fetch(1)", "GET nothing"]
    texts = _table(spark, sf_dir, "pages").select(F.col("html").alias("text")).unionByName(_table(spark, sf_dir, "documents").select("text")).unionByName(_table(spark, sf_dir, "events").select(F.col("props").alias("text")))
    texts = texts.unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, own))).alias("text")))
    return texts.groupBy(detect_format("text").alias("format")).agg(F.count("*").alias("n"))


SQL["q_detect_format"] = r"""
with own as (select unnest(['GET /a HTTP/1.1' || chr(13) || chr(10) || 'Host: x', 'HTTP/1.1 200 OK', 'curl -u a:b https://x', 'fetch("x")', '{"log": {"entries": []}}', '<items burpVersion="1"/>', '{"info": {"_postman_id": "1"}}', '  await fetch(1)', 'GET nothing']) t),
a as (select ltrim(t, ' ' || chr(9) || chr(10) || chr(13)) t from (select html t from pages union all select text from documents union all select props from events union all select t from own)),
l as (select t, replace(split_part(t, chr(10), 1), chr(13), '') line from a)
select case when starts_with(t, '<') and (contains(t, 'burpVersion') or contains(t, '<item>')) then 'burp_xml' when starts_with(t, '{') and (contains(t, '"_postman_id"') or contains(t, 'schema.getpostman.com')) then 'postman'
when starts_with(t, '{') and contains(t, '"log"') and contains(t, '"entries"') then 'har' when starts_with(t, 'curl ') then 'curl' when starts_with(t, 'fetch(') or starts_with(t, 'await fetch(') then 'fetch'
when regexp_matches(line, '^[A-Z]{3,10} \S+ HTTP/[0-9](\.[0-9])?$') then 'http_request' when starts_with(line, 'HTTP/') then 'http_response' else 'text' end as format, count(*) n from l group by 1"""


# whole texts


@query
def q_redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "format", F.size("findings").alias("n_findings"), F.md5("output").alias("output_md5"))


_ANY = f"{tables.EMAIL}|{tables.CARD}|{tables.IPV4}"
_FOUND = rf"""(select doc_id, i, t, "match" m, i % 2 = 1 and case when contains("match", '@') then true when regexp_matches("match", '^{tables.IPV4[2:-2]}$') then
  (case when "start" > 0 then t["start"] else '' end) not in ('.', '/') and t["start" + len("match") + 1] <> '.' else {_luhn('"match"')} end hit,
  case when i % 2 = 0 then '' when contains("match", '@') then {_email('"match"')} when regexp_matches("match", '^{tables.IPV4[2:-2]}$') then {_ipv4('"match"')} else {_card('"match"')} end masked,
  case when i % 2 = 0 then '' when contains("match", '@') then 'email' when regexp_matches("match", '^{tables.IPV4[2:-2]}$') then 'ip' else 'card' end category
  from {_matches("documents", "doc_id", "text", _ANY)})"""
#: The documents have no other kinds of finding than these.
SQL["q_redact_documents"] = f"select doc_id, 'text' as format, count_if(hit)::int n_findings, md5(string_agg(case when hit then masked else m end, '' order by i)) output_md5 from {_FOUND} group by doc_id"


@query
def q_summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(redact(_table(spark, sf_dir, "documents").select("text")))


SQL["q_summary_by_category"] = f"select category, count(*) n from {_FOUND} where hit group by 1"


@query
def q_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = most_frequent(redact(_table(spark, sf_dir, "documents").select("text")))
    return counts.select("category", "n", (F.monotonically_increasing_id() + 1).alias("position"))


_ORDERED = "list_position([" + ", ".join(f"'{c}'" for c in tables.CATEGORIES) + "], category)"
SQL["q_most_frequent"] = f"select category, n, row_number() over (order by n desc, {_ORDERED}) as \"position\" from ({SQL['q_summary_by_category']})"


@query
def q_findings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact(_table(spark, sf_dir, "documents").select("source", "text"))
    return done.groupBy("source").agg(F.sum(F.size("findings")).alias("n"), F.count_if(F.size("findings") > 0).alias("documents"))


SQL["q_findings_by_source"] = f"select source, sum(n)::bigint n, count_if(n > 0) documents from (select doc_id, count_if(hit) n from {_FOUND} group by doc_id) join documents using (doc_id) group by source"


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the e-mail and address detectors as expressions, overlaps resolved."""

    def typed(pattern: str, category: str, mask) -> F.Column:
        return F.transform(spans.scan("text", pattern), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(category).alias("category"), mask(m.match).alias("replacement")))

    both = F.concat(typed(tables.EMAIL, "email", lambda m: masks.mask_email(m, KEEP)), typed(r"[A-Za-z0-9.]*@[A-Za-z0-9]+", "user", lambda m: F.lit("[U]")))
    return _table(spark, sf_dir, "documents").select("doc_id", "text", both.alias("found")).withColumn("kept", spans.resolve("found"))


@query
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _native(spark, sf_dir).withColumn("output", spans.apply("text", "kept"))
    return done.select("doc_id", F.size("found").alias("n_found"), F.size("kept").alias("n_kept"), F.md5("output").alias("output_md5"))


SQL["q_resolve"] = f"""select doc_id, (count_if(i % 2 = 1) * 2)::int n_found, count_if(i % 2 = 1)::int n_kept, md5(string_agg(case when i % 2 = 1 then {_email('"match"')} else "match" end, '' order by i)) output_md5
from {_matches("documents", "doc_id", "text", tables.EMAIL)} group by doc_id"""


@query
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _native(spark, sf_dir).withColumn("parts", spans.segments("text", "kept"))
    revealed = F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0)))
    back = F.array_join(F.transform("parts", lambda s: s.original), "") == F.col("text")
    return parts.select("doc_id", F.size("parts").alias("n"), back.alias("joins_back"), F.md5(spans.compose("parts", revealed)).alias("revealed_md5"))


SQL["q_segments"] = f"""select doc_id, count_if(i % 2 = 1 or "match" <> '')::int n, true joins_back, md5(first(t)) revealed_md5 from {_matches("documents", "doc_id", "text", tables.EMAIL)} group by doc_id"""


@query
def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact(_table(spark, sf_dir, "documents").select("doc_id", "text"), TERMS)
    kinds = ("client", "user", "host", "custom")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings.category", lambda c: c == kind)).alias(f"n_{kind}")

    return done.select("doc_id", *map(count, kinds))


SQL["q_terms"] = rf"""
with m as (select doc_id, i, "match" p, case when "start" > 0 then t["start"] else '' end prv, t["start" + len("match") + 1] nxt from {_matches("documents", "doc_id", "lower(text)", "tion[ ._-]the|tionthe|and the|the of|onthe|of")})
select doc_id, count_if(i % 2 = 1 and starts_with(p, 'tion'))::int n_client, count_if(i % 2 = 1 and p = 'the of')::int n_user, count_if(i % 2 = 1 and p = 'onthe')::int n_host,
  count_if(i % 2 = 1 and (p = 'and the' or (p = 'of' and not regexp_matches(nxt, '[\p{{L}}\p{{N}}]') and not regexp_matches(prv, '[\p{{L}}\p{{N}}]'))))::int n_custom
from m group by doc_id"""


# vault


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as it is read more than once."""
    done = redact(_table(spark, sf_dir, "documents").select("lang", "text"))
    return materialise(vault.record(done, F.col("lang"), F.lit(1_700_000_000)), "vault")


_VAULT = f"(select lang as profile, masked as replacement, m as value, count(*) uses, 1700000000::bigint last_used from {_FOUND} join documents using (doc_id) where hit and m <> masked group by 1, 2, 3)"


@query
def q_vault_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vault(spark, sf_dir)


SQL["q_vault_record"] = f"select * from {_VAULT}"


@query
def q_vault_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vault.candidates(_vault(spark, sf_dir))
    return c.select("profile", "replacement", "n", F.array_join("originals", "|").alias("originals"))


SQL["q_vault_candidates"] = f"""select profile, replacement, max(n) n, string_agg(value, '|' order by r) originals from
  (select *, row_number() over (partition by profile, replacement order by uses desc, last_used desc, value) r, count(*) over (partition by profile, replacement) n from {_VAULT}) where r <= {vault.MAX_CANDIDATES} group by 1, 2"""


@query
def q_vault_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.prune(_vault(spark, sf_dir), 3)


SQL["q_vault_prune"] = f"select v.* from {_VAULT} v join (select profile, replacement, row_number() over (partition by profile order by replacement desc) r from (select distinct profile, replacement from {_VAULT})) using (profile, replacement) where r <= 3"


@query
def q_restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts with what could be put back; a replacement of several originals stays."""
    done = redact(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = materialise(vault.record(done, F.lit("all"), F.lit(1)), "vault")
    back = vault.restore(done.select("doc_id", "text", F.col("output").alias("masked")), known, "masked")
    return back.select("doc_id", "n_restored", "n_ambiguous", (F.col("restored") == F.col("text")).alias("same"))


SQL["q_restore_roundtrip"] = f"""with f as (select doc_id, masked, m from {_FOUND} where hit and m <> masked), several as (select masked from f group by masked having count(distinct m) > 1),
n as (select doc_id, count_if(masked not in (select masked from several))::int n_restored, count_if(masked in (select masked from several))::int n_ambiguous from f group by doc_id)
select doc_id, coalesce(n_restored, 0)::int n_restored, coalesce(n_ambiguous, 0)::int n_ambiguous, coalesce(n_ambiguous, 0) = 0 same from documents left join n using (doc_id)"""


@query
def q_vault_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault after encryption and decryption."""
    key = vault.key_from_hex("ab" * 32)
    return vault.open_sealed(vault.seal(_vault(spark, sf_dir), key), key)


SQL["q_vault_sealed"] = f"select * from {_VAULT}"


# comparison of two roles, made from the pages


def _items(spark: SparkSession, sf_dir: str, role: int | None = None) -> DataFrame:
    """Items of all pages, or of one side of the comparison."""
    pages = _table(spark, sf_dir, "pages")
    pages = pages if role is None else pages.where(F.col("page_id") % 3 != role)
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)?", 1)
    status = F.when(F.col("page_id") % 7 == 0, "403").when(F.col("page_id") % 11 == 0, "x").otherwise("200")
    raw = pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.lit("443").alias("port"), F.regexp_extract("url", "^([a-z]+):", 1).alias("protocol"), F.lit("get").alias("method"), path.alias("path"), status.alias("status"),
        F.when(F.col("page_id") % 13 == 0, "CSS").otherwise("HTML").alias("mimetype"), F.lit("null").alias("extension"), F.lit(b"").alias("request"), F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n"), "html"), "UTF-8").alias("response"),
    )
    return sitemap.items(raw)


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.compare(*(sitemap.endpoint_stats(_items(spark, sf_dir, side), keys=False, most=None) for side in (0, 1)))


def _stem(s: str) -> str:
    u = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return f"""(case when {s} = '' then '' when regexp_matches({s}, '^[0-9]+$') then '{{id}}' when regexp_matches(lower({s}), '^{u}$') then '{{uuid}}' when regexp_matches(lower({s}), '^[0-9a-f]{{16,}}$') then '{{hex}}'
      when contains({s}, '@') or contains(lower({s}), '%40') then '{{email}}' when contains({s}, '=') or contains(lower({s}), '%3d') then '{{value}}'
      when strlen({s}) >= 20 and regexp_matches({s}, '[0-9]') and regexp_matches({s}, '[A-Za-z]') then '{{token}}' when regexp_matches({s}, '[0-9]{{4,}}') then '{{id}}' else {s} end)"""


_SEGMENT = f"(case when regexp_extract(s, '^(.+)\\.([A-Za-z0-9]{{0,5}})$', 1) <> '' and starts_with({_stem('''regexp_extract(s, '^(.+)\\.([A-Za-z0-9]{0,5})$', 1)''')}, '{{') then {_stem('''regexp_extract(s, '^(.+)\\.([A-Za-z0-9]{0,5})$', 1)''')} || '.' || regexp_extract(s, '^(.+)\\.([A-Za-z0-9]{{0,5}})$', 2) else {_stem('s')} end)"
_PATH = f"coalesce(nullif(array_to_string(list_transform(list_transform(string_split(split_part(p, '?', 1), '/'), lambda x: split_part(x, ';', 1)), lambda s: {_SEGMENT}), '/'), ''), '/')"
_CLEAN = f"(case when regexp_matches(q, '^[A-Za-z_][A-Za-z0-9_-]{{0,63}}$') and not starts_with({_stem('q')}, '{{') then q else '{{key}}' end)"


def _sql_items(role: int | None = None) -> str:
    side = "" if role is None else f" where page_id % 3 <> {role}"
    return f"""(select regexp_extract(url, '^([a-z]+):', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || case when starts_with(url, 'https:') then '' else ':443' end origin, {_PATH} as path,
      list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(regexp_extract(p, '\\?(.*)$', 1), '&'), lambda x: x), lambda x: x <> ''), lambda x: {_CLEAN.replace("q,", "split_part(x, '=', 1),").replace(" q ", " split_part(x, '=', 1) ").replace("then q", "then split_part(x, '=', 1)").replace("(q)", "(split_part(x, '=', 1))")}))) query,
      page_id % 13 = 0 as static, case when page_id % 7 = 0 then 403 when page_id % 11 = 0 then null else 200 end status, html body, p as concrete,
      array_to_string(list_filter(string_split_regex(regexp_replace(html, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}|[A-Za-z0-9+/_=-]{{24,}}|[0-9a-fA-F]{{16,}}|[0-9]+', '#', 'g'), '\\s+'), lambda x: x <> ''), ' ') loose
      from (select *, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)?', 1) p from pages{side}))"""


def _sql_stats(role: int | None = None) -> str:
    return f"""(select origin, path, query, count(*) requests, min(strlen(body))::bigint min_size, max(strlen(body))::bigint max_size, list_sort(list(distinct status)) statuses,
      coalesce(list(distinct body) filter (status between 200 and 299), []) exact, coalesce(list(distinct loose) filter (status between 200 and 299), []) loose, coalesce(list(distinct concrete) filter (status between 200 and 299), []) objects
      from {_sql_items(role)} where status is not null and not static group by 1, 2, 3)"""


_COMPARE = f"""(select coalesce(h.origin, l.origin) origin, coalesce(h.path, l.path) path, coalesce(h.query, l.query) query, h.requests h_requests, l.requests l_requests,
  coalesce(list_has_any(h.exact, l.exact), false) identical, coalesce(list_has_any(h.objects, l.objects), false) same_object,
  case when l.origin is null then 'high_only' when h.origin is null then 'low_only' when list_contains(h.statuses, 200) and list_contains(l.statuses, 200) then
    case when list_has_any(h.exact, l.exact) or list_has_any(h.loose, l.loose) then 'same_content' else 'different_content' end
  when list_contains(h.statuses, 200) then 'enforced' when list_contains(l.statuses, 200) then 'inverted' else 'no_access' end as class
  from {_sql_stats(0)} h full outer join {_sql_stats(1)} l on h.origin = l.origin and h.path = l.path and h.query = l.query)"""
_LABEL = "('GET ' || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end)"


@query
def q_template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = _items(spark, sf_dir)
    return of.groupBy("origin", "path", F.array_join("query", "&").alias("query")).agg(F.count("*").alias("n"))


SQL["q_template_paths"] = f"select origin, path, array_to_string(query, '&') query, count(*) n from {_sql_items()} group by 1, 2, 3"


@query
def q_endpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sitemap.endpoint_stats(_items(spark, sf_dir), keys=False)
    return s.select(sitemap.label().alias("label"), "origin", "requests", "min_size", "max_size", F.array_join(F.transform("statuses", lambda x: x.cast("string")), ", ").alias("statuses"), F.col("n_exact").cast("int"), F.col("n_loose").cast("int"))


SQL["q_endpoint_stats"] = f"select {_LABEL} as label, origin, requests, min_size, max_size, array_to_string(statuses, ', ') statuses, len(exact)::int n_exact, len(loose)::int n_loose from {_sql_stats()}"


@query
def q_compare_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).select("origin", sitemap.label().alias("label"), "class", "identical", "same_object", F.col("high.requests").alias("h_requests"), F.col("low.requests").alias("l_requests"))


SQL["q_compare_classes"] = f"select origin, {_LABEL} as label, class, identical, same_object, h_requests, l_requests from {_COMPARE}"


@query
def q_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.left_out(_items(spark, sf_dir))


SQL["q_left_out"] = f"select count_if(status is null) unrequested, count_if(status is not null and static) static_items from {_sql_items()}"


@query
def q_section_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = sitemap.listed(_pair(spark, sf_dir), 5)
    return shown.select("class", "position", "total", "origin", sitemap.label().alias("label"))


SQL["q_section_topk"] = f"""select class, r::int as "position", total, origin, {_LABEL} as label from (select *, row_number() over (partition by class order by origin, path, query) r, count(*) over (partition by class) total from {_COMPARE}) where r <= 5"""


@query
def q_top_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.top_prefixes(_pair(spark, sf_dir), above=2)


SQL["q_top_prefixes"] = f"""with c as (select class, '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[:2], '/') prefix, count(*) n from {_COMPARE} group by 1, 2)
select class, prefix, n from (select *, row_number() over (partition by class order by n desc, prefix) r, sum(n) over (partition by class) total from c) where r <= 10 and total > 2"""


@query
def q_key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON keys of the events' props on either side of a user split."""
    e = _table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("side"), sitemap.json_keys(F.encode("props", "UTF-8")).alias("keys"))
    return e.groupBy("event_type").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("side") == 0, F.col("keys")))))), ",").alias("even"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("side") == 1, F.col("keys")))))), ",").alias("odd"))


SQL["q_key_differences"] = """select event_type, coalesce(string_agg(distinct k, ',' order by k) filter (user_id % 2 = 0), '') even, coalesce(string_agg(distinct k, ',' order by k) filter (user_id % 2 = 1), '') odd
from (select event_type, user_id, unnest(json_keys(props)) k from events) group by 1"""


# entities


@query
def q_entity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("(?U)" + tables.WORD)).alias("n"))
    return d.select("doc_id", "n", F.explode(entities.windows(F.col("n"))).alias("w")).select("doc_id", "n", "w.start", "w.end")


SQL["q_entity_windows"] = r"""with d as (select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+(?:[-_][\p{L}\p{N}\p{M}_]+)*|[^\s]')) n from documents)
select doc_id, n::int n, (k * 224)::int as "start", least(k * 224 + 256, n)::int as "end" from (select doc_id, n, unnest(range(greatest(ceil((n - 32) / 224.0)::int, 1))) k from d where n > 0)"""


def _capitals():
    import numpy as np

    def score(words, labels):
        out = np.full((len(words), len(labels), 3), -4.0)
        out[[w[:1].isupper() for w in words], 0] = 0.0  # even odds, which add up exactly
        return out

    return score


@query
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stand-in for the model: capitalised words are persons."""
    found = entities.find(_table(spark, sf_dir, "benchmark"), _capitals, ("person", "password"))
    return found.select("item_id", F.explode("entities").alias("e")).select("item_id", "e.start", "e.end", "e.label", "e.replacement", "e.category", "e.score")


_BENCH_WORDS = _matches("benchmark", "item_id", "text", r"[\p{L}\p{N}\p{M}_]+(?:[-_][\p{L}\p{N}\p{M}_]+)*|[^\s]")
SQL["q_entities"] = f"""select item_id, "start", cast("start" + len("match") as int) "end", 'person' as label, {_keep_head('"match"')} replacement, 'pii' as category, 0.5::double score
from {_BENCH_WORDS} where i % 2 = 1 and regexp_matches("match", '^\\p{{Lu}}')"""


@query
def q_stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts through a stream, to a table that is read back."""
    import uuid

    from ..streaming.flows import masked

    schema = _table(spark, sf_dir, "documents").schema
    at = f"{shared_dir(spark)}/veilspark/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    masked(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "source", F.size("findings").alias("n_findings"), F.md5("output").alias("output_md5"))


SQL["q_stream_redact"] = f"select doc_id, source, n_findings, output_md5 from ({SQL['q_redact_documents']}) join documents using (doc_id)"
