"""Registered queries of the detectors, masks and renderings, over texts made from table keys.

A case is a text and what must come out of it, both written in SQL over ``customer``: the
text in the words that Spark and DuckDB share, the outcome in DuckDB's. ``K`` is the
customer's key as text, ``H`` its MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.redact import redact
from ..policy import Policy, Term
from .queries import QUERIES, SQL, _cut_tail, _email, _host, _keep_head, _secret, _table

K, H = "cast(c_custkey as string)", "md5(cast(c_custkey as string))"
LF, APOS, SLASH = "chr(10)", "chr(39)", "chr(92)"


def _join(*parts: str) -> str:
    """Parts as one SQL text: what begins with ``=`` is an expression, the rest is as it is."""
    return "concat(" + ", ".join(p[1:] if p.startswith("=") else "'" + p + "'" for p in parts) + ")"


def _b64(x: str) -> str:
    return f"<b64>{x}</b64>"


def _url64(x: str) -> str:
    return f"translate({_b64(x)}, '+/=', '-_')"


def _dialect(sql: str, spark: bool) -> str:
    return sql.replace("<b64>", "translate(base64(cast(" if spark else "base64(encode(").replace("</b64>", " as binary)), concat(chr(13), chr(10)), '')" if spark else "))")


def _jwt(payload: str, signature: str) -> str:
    return f"concat({_url64(_HEAD)}, '.', {_url64(payload)}, '.', {signature})"


_HEAD = """'{"alg":"HS256","typ":"JWT"}'"""
_CLAIMS = _join('{"sub":"user-', f"={K}", '","email":"ann', f"={K}", '@corp-mail.com","iat":1700000000,"role":"admin","amr":["a","b"],"active":true}')
_SHOWN = _join("[JWT header{alg=HS256, typ=JWT} payload{sub=", f"={_cut_tail(_join('user-', f'={K}'))}", ", email=", f"={_email(_join('ann', f'={K}', '@corp-mail.com'))}", ", iat=1700000000, role=admin, amr=[a, b], active=true} sig=")
_GARBLED = _join("eyJ", f"={H}", ".eyJ", f"={H}", ".", f"={H}")
_UUID = _join("a", f"=substr({H}, 2, 7)", "-b", f"=substr({H}, 9, 3)", "-c", f"=substr({H}, 12, 3)", "-d", f"=substr({H}, 15, 3)", "-e", f"=substr({H}, 18, 11)")


def _vendor(mark: str, rest: str) -> tuple[str, str, str, int]:
    token = _join(mark, f"={rest}")
    return mark, _join("key ", f"={token}", " end"), _join("key ", f"={_secret(token)}", " end"), 1


def _same(name: str, *parts: str) -> tuple[str, str, str, int]:
    return name, _join(*parts), _join(*parts), 0


#: query: (case, text, outcome, findings)
CASES: dict[str, list[tuple[str, str, str, int]]] = {
    "q_private_keys": [
        ("closed", _join("before -----BEGIN RSA PRIVATE KEY-----", f"={LF}", f"={H}", f"={LF}", "-----END RSA PRIVATE KEY----- after"), _join("before -----BEGIN RSA PRIVATE KEY-----[REDACTED]-----END RSA PRIVATE KEY----- after"), 1),
        ("plain", _join("-----BEGIN PRIVATE KEY-----", f"={H}", "-----END PRIVATE KEY-----"), _join("-----BEGIN PRIVATE KEY-----[REDACTED]-----END PRIVATE KEY-----"), 1),
        _same("open", "x -----BEGIN PRIVATE KEY----- ", f"={K}"),
    ],
    "q_jwt": [
        ("signed", _join("tok ", f"={_jwt(_CLAIMS, H)}", " end"), _join("tok ", f"={_SHOWN}", "…[len=32]] end"), 1),
        ("unsigned", _join("tok ", f"={_jwt(_CLAIMS, chr(39) * 2)}", " end"), _join("tok ", f"={_SHOWN}", "<none>] end"), 1),
        ("not_json", _join("tok ", f"={_GARBLED}", " end"), _join("tok ", f"={_secret(_GARBLED)}", " end"), 1),
        ("nested", _join("tok ", f"={_jwt(_join('{\"inner\":\"', f'={_jwt(_CLAIMS, H)}', '\"}'), H)}", " end"), _join("tok [JWT header{alg=HS256, typ=JWT} payload{inner=", f"={_SHOWN}", "…[len=32]]} sig=…[len=32]] end"), 1),
    ],
    "q_vendor_tokens": [
        _vendor("AKIA", f"upper(substr({H}, 1, 16))"), _vendor("ASIA", f"upper(substr({H}, 3, 16))"), _vendor("ghp_", _join(f"={H}", "abcd")), _vendor("github_pat_", H), _vendor("glpat-", H), _vendor("sk_live_", H),
        _vendor("rk_test_", H), _vendor("sk-", H), _vendor("xoxb-", H), _vendor("AIza", _join(f"={H}", "abc")), _vendor("ya29.", H),
        _same("short", "key sk-", f"=substr({H}, 1, 8)"),
    ],
    "q_url_credentials": [
        ("both", _join("https://user", f"={K}", ":pw", f"={H}", "@db.example.com/x"), _join("https://", f"={_keep_head(_join('user', f'={K}'))}", ":", f"={_secret(_join('pw', f'={H}'))}", "@db.example.com/x"), 2),
        _same("none", "https://db.example.com/x?page=", f"={K}"),
    ],
    "q_uuid_ipv6": [
        ("uuid", _join("trace ", f"={_UUID}", " end"), _join("trace ", f"={_cut_tail(_UUID)}", " end"), 1),
        ("ipv6", _join("from 2001:db8::", f"=cast(c_custkey % 9000 as string)", " ok"), _join("from 2001::* ok"), 1),
        ("link_local", _join("from fe80::", f"=cast(c_custkey % 9000 as string)", " ok"), _join("from fe80::* ok"), 1),
        _same("time", "at 12:34:5", f"=cast(c_custkey % 10 as string)"),
        _same("loopback", "on ::1 only ", f"={K}"),
    ],
    "q_headers": [
        ("line", _join("GET /a HTTP/1.1", f"={LF}", "X-Api-Key: ", f"={H}", f"={LF}", "Accept: text/plain"), _join("GET /a HTTP/1.1", f"={LF}", "X-Api-Key: ", f"={_secret(H)}", f"={LF}", "Accept: text/plain"), 1),
        ("any_case", _join("x-csrf-token:", f"={H}"), _join("x-csrf-token:", f"={_secret(H)}"), 1),
        ("quoted", _join("-H ", f"={APOS}", "X-Auth-Token: ", f"={H}", f"={APOS}", " -v"), _join("-H ", f"={APOS}", "X-Auth-Token: ", f"={_secret(H)}", f"={APOS}", " -v"), 1),
        _same("empty", "X-Api-Key: "),
        _same("other", "Accept: ", f"={H}"),
    ],
    "q_cookies": [
        ("request", _join("Cookie: sid=", f"={H}", "; theme=dark", f"={K}"), _join("Cookie: sid=", f"={_secret(H)}", "; theme=", f"={_secret(_join('dark', f'={K}'))}"), 2),
        ("response", _join("Set-Cookie: sid=", f"={H}", "; Path=/; Secure"), _join("Set-Cookie: sid=", f"={_secret(H)}", "; Path=/; Secure"), 1),
    ],
    "q_authorization": [
        ("bearer", _join("Authorization: Bearer ", f"={H}"), _join("Authorization: Bearer ", f"={_secret(H)}"), 1),
        ("no_scheme", _join("Authorization: ", f"={H}"), _join("Authorization: ", f"={_secret(H)}"), 1),
        ("basic", _join("Authorization: Basic ", f"={_b64(_join('user', f'={K}', ':pw', f'={H}'))}"), _join("Authorization: Basic [basic-auth ", f"={_keep_head(_join('user', f'={K}'))}", ":", f"={_secret(_join('pw', f'={H}'))}", "]"), 1),
        ("basic_no_pair", _join("Authorization: Basic ", f"={_b64(H)}"), _join("Authorization: Basic ", f"={_secret(_b64(H))}"), 1),
        ("digest", _join('Authorization: Digest username="bob", realm="x", nonce="', f"={H}", '"'), _join('Authorization: Digest username="…[len=3]", realm="x", nonce="', f"={_secret(H)}", '"'), 2),
        ("unknown", _join("Authorization: Custom ", f"={H}"), _join("Authorization: Custom ", f"={_secret(H)}"), 1),
    ],
    "q_curl": [
        ("user", _join("curl -u user", f"={K}", ":pw", f"={H}", " https://example.com/"), _join("curl -u ", f"={_keep_head(_join('user', f'={K}'))}", ":", f"={_secret(_join('pw', f'={H}'))}", " https://example.com/"), 1),
        ("user_quoted", _join("curl --user ", f"={APOS}", "ann smith:pw", f"={H}", f"={APOS}"), _join("curl --user ", f"={APOS}", f"={_keep_head(chr(39) + 'ann smith' + chr(39))}", ":", f"={_secret(_join('pw', f'={H}'))}", f"={APOS}"), 1),
        ("user_only", _join("curl -u user", f"={K}"), _join("curl -u ", f"={_keep_head(_join('user', f'={K}'))}"), 1),
        ("cookie", _join("curl -b ", f"={APOS}", "sid=", f"={H}", "; a=bcdefgh", f"={APOS}"), _join("curl -b ", f"={APOS}", "sid=", f"={_secret(H)}", "; a=", f"={_secret(chr(39) + 'bcdefgh' + chr(39))}", f"={APOS}"), 2),
    ],
    "q_json_string_pairs": [
        ("secret", _join('{"password": "', f"={H}", '", "note": "plain"}'), _join('{"password": "', f"={_secret(H)}", '", "note": "plain"}'), 1),
        ("name", _join('{"fullName":"Ann Bobson", "userId":"u', f"={K}", '"}'), _join('{"fullName":"An* Bob***", "userId":"', f"={_cut_tail(_join('u', f'={K}'))}", '"}'), 2),
        ("in_json", _join("{", f"={SLASH}", '"token', f"={SLASH}", '":', f"={SLASH}", '"', f"={H}", f"={SLASH}", '"}'), _join("{", f"={SLASH}", '"token', f"={SLASH}", '":', f"={SLASH}", '"', f"={_secret(H)}", f"={SLASH}", '"}'), 1),
        ("header_key", _join('{"X-Api-Key":"', f"={H}", '"}'), _join('{"X-Api-Key":"', f"={_secret(H)}", '"}'), 1),
        ("metadata", _join('{"token_type":"', f"={K}", '", "passwordUrl": "x"}'), _join('{"token_type":"', f"={K}", '", "passwordUrl": "x"}'), 0),
    ],
    "q_json_number_ids": [
        ("id", _join('{"userId": 10', f"={K}", ', "price": 12345}'), _join('{"userId": ', f"={_cut_tail(_join('10', f'={K}'))}", ', "price": 12345}'), 1),
    ],
    "q_name_value_pairs": [
        ("secret", _join('{"name": "session", "value": "', f"={H}", '"}'), _join('{"name": "session", "value": "', f"={_secret(H)}", '"}'), 1),
        ("code", _join('{"key":"code","value":"', f"={H}", '"}'), _join('{"key":"code","value":"', f"={_secret(H)}", '"}'), 1),
        ("in_cookies", _join('{"cookies": [{"name":"theme","value":"dark', f"={H}", '"}]}'), _join('{"cookies": [{"name":"theme","value":"', f"={_secret(_join('dark', f'={H}'))}", '"}]}'), 1),
        _same("other", '{"name":"theme","value":"dark', f"={H}", '"}'),
    ],
    "q_params": [
        ("query", _join("/a?code=", f"={H}", "&page=2&email=ann"), _join("/a?code=", f"={_secret(H)}", "&page=2&email=an*"), 2),
        # the cookie and the parameter are one finding
        ("once", _join("Cookie: sid=", f"={H}"), _join("Cookie: sid=", f"={_secret(H)}"), 1),
    ],
    "q_encoded_messages": [
        ("xml", _join('<items burpVersion="1"><item><response base64="true"><![CDATA[', f"={_b64(_join('mail ann', f'={K}', '@corp.com'))}", "]]></response></item></items>"),
         _join('<items burpVersion="1"><item><response base64="false"><![CDATA[mail ', f"={_email(_join('ann', f'={K}', '@corp.com'))}", "]]></response></item></items>"), 1),
    ],
}

#: Terms inside of values that are masked in other ways.
TERMED = Policy(client=("Globex Corp",), users=("jsmith",), terms=(Term("acme", "[X]"),))
TERM_CASES = [
    ("secret", _join('{"password":"acme', f"={H}", '"}'), _join('{"password":"[X]', f"=substr({H}, 1, 6)", '…[len=36]"}'), 1),
    ("name", _join('{"fullName":"Ann acme B', f"={K}", '"}'), _join('{"fullName":"An* [X] ', f"={_keep_head(_join('B', f'={K}'))}", '"}'), 1),
    ("id", _join('{"userId":"acme-', f"={K}", '"}'), _join('{"userId":"', f"={_cut_tail(_join('acme-', f'={K}'))}", '"}'), 1),
    ("email", _join("mail acme.ann", f"={K}", "@corp.com"), _join("mail [X]", f"={_keep_head(_join('.ann', f'={K}'))}", "@", f"={_host(chr(39) + 'corp.com' + chr(39))}"), 1),
    ("host", _join("see acme.corp.com now ", f"={K}"), _join("see [X].co**.com now ", f"={K}"), 1),
    ("client", _join("for globex-CORP and Globex  corp ", f"={K}"), _join("for [CLIENT] and Globex  corp ", f"={K}"), 1),
    ("user", _join("by jsmith", f"={K}"), _join("by jsm***", f"={K}"), 1),
]


def _rows(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str, str, int]]) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.expr(_dialect(text, True)).alias("text")) for name, text, _, _ in cases))
    return customers.select("c_custkey", F.explode(each).alias("c")).select("c_custkey", F.col("c.name").alias("name"), F.col("c.text").alias("text"))


def _sql(cases: list[tuple[str, str, str, int]]) -> str:
    return " union all ".join(f"select c_custkey, '{name}' as name, {_dialect(shown, False)} as output, {n}::int as n_findings from customer" for name, _, shown, n in cases)


def _masked(cases: list[tuple[str, str, str, int]], policy: Policy = Policy()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return redact(_rows(spark, sf_dir, cases), policy).select("c_custkey", "name", "output", F.size("findings").alias("n_findings"))

    return run


for _name, _cases in CASES.items():
    QUERIES[_name], SQL[_name] = _masked(_cases), _sql(_cases)
QUERIES["q_terms_in_masks"], SQL["q_terms_in_masks"] = _masked(TERM_CASES, TERMED), _sql(TERM_CASES)
assert scalars.secret("x" * 32, 0.3) == "x" * 9 + "…[len=32]"


#: Texts of whole formats with several planted values each.
_MAIL = _join("ann", f"={K}", "@corp-mail.com")
FORMAT_CASES = [
    ("http_request",
     _join("POST /api/users/88", f"={K}", "?code=", f"={H}", " HTTP/1.1", f"={LF}", "Host: app", f"={K}", ".corp-mail.com", f"={LF}", "Authorization: Bearer ", f"={H}", f"={LF}", "Cookie: sid=", f"={H}", f"={LF}", f"={LF}", '{"email":"', f"={_MAIL}", '","password":"', f"={H}", '"}'),
     _join("POST /api/users/", f"={_cut_tail(_join('88', f'={K}'))}", "?code=", f"={_secret(H)}", " HTTP/1.1", f"={LF}", "Host: ", f"={_host(_join('app', f'={K}', '.corp-mail.com'))}", f"={LF}", "Authorization: Bearer ", f"={_secret(H)}", f"={LF}", "Cookie: sid=", f"={_secret(H)}", f"={LF}", f"={LF}",
           '{"email":"', f"={_email(_MAIL)}", '","password":"', f"={_secret(H)}", '"}'), 7),
    ("http_response",
     _join("HTTP/1.1 200 OK", f"={LF}", "Set-Cookie: sid=", f"={H}", "; Path=/", f"={LF}", f"={LF}", '{"id":10', f"={K}", ',"ip":"203.0.113.45","card":"4111 1111 1111 1111"}'),
     _join("HTTP/1.1 200 OK", f"={LF}", "Set-Cookie: sid=", f"={_secret(H)}", "; Path=/", f"={LF}", f"={LF}", '{"id":', f"={_cut_tail(_join('10', f'={K}'))}", ',"ip":"203.*.*.*","card":"4111 **** **** 1111"}'), 4),
    ("har",
     _join('{"log":{"entries":[{"request":{"headers":[{"name":"X-Api-Key","value":"', f"={H}", '"}],"cookies":[{"name":"a","value":"', f"={H}", '"}],"queryString":[{"name":"code","value":"', f"={H}", '"},{"name":"page","value":"2"}]}}]}}'),
     _join('{"log":{"entries":[{"request":{"headers":[{"name":"X-Api-Key","value":"', f"={_secret(H)}", '"}],"cookies":[{"name":"a","value":"', f"={_secret(H)}", '"}],"queryString":[{"name":"code","value":"', f"={_secret(H)}", '"},{"name":"page","value":"2"}]}}]}}'), 3),
    ("curl",
     _join("curl ", f"={APOS}", "https://example.com/users/77", f"={K}", f"={APOS}", " -H ", f"={APOS}", "Authorization: Bearer ", f"={H}", f"={APOS}", " -b ", f"={APOS}", "sid=", f"={H}", f"={APOS}"),
     _join("curl ", f"={APOS}", "https://example.com/users/", f"={_cut_tail(_join('77', f'={K}'))}", f"={APOS}", " -H ", f"={APOS}", "Authorization: Bearer ", f"={_secret(H)}", f"={APOS}", " -b ", f"={APOS}", "sid=", f"={_secret(H)}", f"={APOS}"), 3),
    ("text",
     _join("2024-01-01 12:00:00 INFO login of ", f"={_MAIL}", " from 10.1.2.", "=cast(c_custkey % 200 as string)", " trace ", f"={_UUID}"),
     _join("2024-01-01 12:00:00 INFO login of ", f"={_email(_MAIL)}", " from 10.1.*.* trace ", f"={_cut_tail(_UUID)}"), 3),
]


def q_whole_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format whole: what it is found to be, its masked form, and that no planted value is left."""
    done = redact(_rows(spark, sf_dir, FORMAT_CASES))
    key = F.col("c_custkey").cast("string")
    left = F.contains("output", F.md5(key)) | F.contains("output", F.concat(F.lit("ann"), key, F.lit("@")))
    return done.select("c_custkey", "format", "output", F.size("findings").alias("n_findings"), left.alias("left_over"))


QUERIES["q_whole_formats"] = q_whole_formats
SQL["q_whole_formats"] = f"select c_custkey, name as format, output, n_findings, false left_over from ({_sql(FORMAT_CASES)})"
