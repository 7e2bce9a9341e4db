"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crypto, secrets, text
from ..operators import codegraph, integrity, journal, reconcile, render, search, sessions
from ..parsers.base import parse_files, symbols_of
from ..sources.adapters import CHANGES_SQL, IMPORTS_SQL, SYMBOLS_SQL, changes, page_imports, part_symbols, table
from ..sources.search_index import SearchIndex
from ..sources.shared import shared_path
from ..streaming.ingest import flag_skew, skew_flags_so_far

Query = Callable[[SparkSession, str], DataFrame]
SINCE, UNTIL = 1_704_067_200, 1_893_456_000
KEY = b"catalogue key"
#: Besides the fixed patterns, what the test tables hold.
PATTERNS = (*secrets.SECRET_PATTERNS, r'token = "[0-9a-f]{40}"', r"[a-z0-9._]+@[a-z0-9.-]+\.[a-z]{2,}")
ALIASES = {"https://*": "web/*", "https://site1*": "one/*", "https://site12*": "twelve/*", "http://*": "plain/*"}
COLS = ["id", "file_path", "commit_hash", "source", "summary", "recorded_at"]
C = ", ".join(COLS)
NEW = "recorded_at DESC, id DESC"


def _events(s, d):
    return changes(s, d)


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Each purchase claims its file's rows so far."""
    return changes(s, d).where("summary = 'purchase'").select(F.col("id").alias("claim_seq"), "file_path", F.concat(F.lit("claim"), F.col("id")).alias("commit_hash"), F.col("id").alias("as_of_id"))


CLAIMS_SQL = f"(SELECT id AS claim_seq, file_path, 'claim' || id AS commit_hash, id AS as_of_id FROM {CHANGES_SQL} WHERE summary = 'purchase')"


def _staged(s, d):
    day = F.date_trunc("day", F.max("ts"))
    e = table(s, d, "events")
    last = e.agg(day.alias("d"))  # one row
    return e.join(F.broadcast(last), F.col("ts") >= F.col("d")).select(F.concat(F.lit("u/"), F.col("user_id")).alias("file_path")).distinct()


def _commit_files(s, d):
    o = table(s, d, "orders")
    return o.select(F.lit("c").alias("commit_hash"), F.col("o_orderkey").cast("string").alias("file_path"), F.floor("o_totalprice").cast("int").alias("add"), (F.col("o_orderkey") % 3).cast("int").alias("del"), (F.col("o_orderkey") % 11 != 0).alias("measurable"))


def _coverage(s, d):
    li = table(s, d, "lineitem")
    agent = li.select(F.lit("c").alias("commit_hash"), F.col("l_orderkey").cast("string").alias("file_path"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.format_string("+%d -%d", F.col("l_quantity").cast("int"), F.lit(1))).alias("diff_stat"))
    files = _commit_files(s, d).withColumn("del", F.col("file_path").cast("long") % 7)
    sums = li.groupBy(F.col("l_orderkey").cast("string").alias("file_path")).agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("q"))
    files = files.join(sums, "file_path").withColumn("add", F.when(F.col("file_path").cast("long") % 2 == 0, F.col("q")).otherwise(F.col("add"))).drop("q")
    return reconcile.coverage(files.withColumn("del", F.col("del").cast("int")), agent)


COVERAGE_SQL = """
WITH li AS (SELECT l_orderkey, l_quantity::INT AS q, l_linenumber FROM lineitem),
 f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN s ELSE floor(o_totalprice)::INT END AS add, o_orderkey % 7 AS del, o_orderkey % 11 <> 0 AS measurable
   FROM orders JOIN (SELECT l_orderkey, sum(q) AS s FROM li GROUP BY 1) ON l_orderkey = o_orderkey),
 a AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber <> 7 THEN q END) AS sa, count(*) FILTER (WHERE l_linenumber <> 7) AS sd, bool_and(l_linenumber <> 7) AS ok FROM li GROUP BY 1)
SELECT o_orderkey::VARCHAR AS file_path, 'c' AS commit_hash, coalesce(n, 0) AS n_rows, measurable AND coalesce(ok, false) AND coalesce(sa = add AND sd = del, false) AS covered,
  measurable AND coalesce(ok, false) AS verifiable FROM f LEFT JOIN a ON l_orderkey = o_orderkey"""


def _orders_journal(s, d):
    """Orders as a signed journal: by key, with a payload that both engines can spell, and some tampering."""
    o = table(s, d, "orders")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    payload = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", at.cast("string"))
    own = crypto.hmac_sha256(payload, KEY)
    tampered = F.when(F.col("o_orderkey") % 97 == 0, F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("?"), at.cast("string"))).otherwise(payload)
    j = o.select(F.col("o_orderkey").alias("id"), at.alias("recorded_at"), F.when(F.col("o_orderkey") % 101 == 0, "").otherwise(own).alias("hmac"), tampered.alias("payload"))
    from ..operators.ordered import look_back

    linked = look_back(j, "id", {"prev_hmac": F.col("hmac")})
    return linked.withColumn("prev_hmac", F.when(F.col("id") % 89 == 0, "x").otherwise(F.coalesce("prev_hmac", F.lit(""))))


def _hmac_sql(payload: str) -> str:
    key = KEY.ljust(64, b"\0")
    blob = lambda b: "'" + "".join(f"\\x{k ^ b:02X}" for k in key) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({payload}))))"


CHAIN_SQL = f"""
WITH o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS recorded_at, o_orderstatus AS st FROM orders),
 j AS (SELECT id, recorded_at, CASE WHEN id % 101 = 0 THEN '' ELSE {_hmac_sql("id || '|' || st || '|' || recorded_at")} END AS hmac,
   {_hmac_sql("id || '|' || CASE WHEN id % 97 = 0 THEN '?' ELSE st END || '|' || recorded_at")} AS want FROM o),
 l AS (SELECT *, lag(hmac) OVER (ORDER BY id) AS before, lag(recorded_at) OVER (ORDER BY id) AS ago FROM j),
 p AS (SELECT *, CASE WHEN id % 89 = 0 THEN 'x' ELSE coalesce(before, '') END AS prev_hmac FROM l)
SELECT id, 'unsigned' AS kind, 'row has no HMAC' AS detail FROM p WHERE hmac = ''
UNION ALL SELECT id, 'link', 'previous HMAC differs' FROM p WHERE hmac <> '' AND before IS NOT NULL AND prev_hmac <> before
UNION ALL SELECT id, 'content', 'HMAC differs from content' FROM p WHERE hmac <> '' AND hmac <> want
UNION ALL SELECT id, 'clock', 'recorded time goes backwards' FROM p WHERE hmac <> '' AND recorded_at < ago"""


def _skew(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("recorded_at"))
    return integrity.skew_flags(o).where("skewed").select("id", "recorded_at")


SKEW_SQL = """SELECT id, recorded_at FROM (SELECT id, recorded_at, max(recorded_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS recorded_at FROM orders)) WHERE recorded_at <> 0 AND m <> 0 AND recorded_at < m - 5"""


def _merkle_sql(leaves: str, keys: str = "") -> str:
    """leaves: (keys, i, h)."""
    k = keys + ", " if keys else ""
    return f"""WITH RECURSIVE leaf AS ({leaves}),
 t({k}lvl, i, h) AS (SELECT {k}0, i, h FROM leaf UNION ALL
  SELECT {k}lvl + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(arg_min(h, i)) || unhex(arg_max(h, i))) ELSE min(h) END FROM t
  WHERE lvl < 24 AND i IS NOT NULL GROUP BY {k}lvl, i // 2)
SELECT {k}h AS root FROM t WHERE lvl = 24 AND i = 0"""


def _pages_files(s, d):
    return table(s, d, "pages").select(F.col("url").alias("file_path")).distinct()


def _ts_pages(s, d):
    """Page addresses as files of the TypeScript family."""
    return table(s, d, "pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 2 == 0, ".ts").otherwise("/index.svelte")).alias("file_path"), "page_id")


TS_SQL = "(SELECT regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 2 = 0 THEN '.ts' ELSE '/index.svelte' END AS file_path, page_id FROM pages)"


def _ts_imports(s, d):
    files = _ts_pages(s, d)
    return files.select("file_path", text.file_key(F.lag("file_path", 3).over(W.partitionBy(F.col("page_id") % 7).orderBy("page_id"))).alias("imported_path")).where("imported_path is not null")


_KEY = "regexp_replace(regexp_replace({c}, '\\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs|svelte|astro)$', ''), '/index$', '')"
TS_IMPORTS_SQL = f"(SELECT file_path, {_KEY.format(c='prev')} AS imported_path FROM (SELECT file_path, lag(file_path, 3) OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS prev FROM {TS_SQL}) WHERE prev IS NOT NULL)"


def _linked(s, d):
    return codegraph.linked_imports(_ts_imports(s, d), _ts_pages(s, d).select("file_path")).select("file_path", "imported_path", "provider")


LINKED_SQL = f"""WITH p AS (SELECT {_KEY.format(c='file_path')} AS imported_path, min(file_path) AS provider FROM {TS_SQL} GROUP BY 1)
SELECT i.file_path, i.imported_path, CASE WHEN provider <> i.file_path THEN provider END AS provider FROM {TS_IMPORTS_SQL} i LEFT JOIN p USING (imported_path)"""


def _drift(s, d):
    doc = table(s, d, "documents").select(F.format_string("d/%d.ts", "doc_id").alias("file_path"), F.col("n_chars").alias("length"), (F.col("doc_id") % 13 == 0).alias("ignored"))
    indexed = table(s, d, "labels").select(F.format_string("d/%d.ts", F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))).alias("file_path")).distinct()
    notes = table(s, d, "labels").select(F.format_string("d/%d.ts", "doc_id").alias("file_path")).distinct()
    return codegraph.drift(indexed, doc, notes, 4000)


DRIFT_SQL = """
WITH doc AS (SELECT 'd/' || doc_id || '.ts' AS file_path, n_chars AS length, doc_id % 13 = 0 AS ignored FROM documents),
 ix AS (SELECT DISTINCT 'd/' || (CASE WHEN doc_id % 17 = 0 THEN doc_id + 1000000000 ELSE doc_id END) || '.ts' AS file_path FROM labels),
 nt AS (SELECT DISTINCT 'd/' || doc_id || '.ts' AS file_path FROM labels)
SELECT 'stale' AS kind, file_path, '' AS reason FROM nt ANTI JOIN ix USING (file_path)
UNION ALL SELECT 'ghost', file_path, '' FROM ix ANTI JOIN doc USING (file_path)
UNION ALL SELECT 'uncovered', file_path, CASE WHEN ignored THEN 'gitignored' WHEN length > 4000 THEN 'too large' ELSE '' END FROM doc ANTI JOIN ix USING (file_path)"""


def _search(query: str) -> Query:
    def run(s, d):
        docs = table(s, d, "documents").select("doc_id", F.col("text").alias("summary"), F.lit("").alias("reason"))
        return docs.where(search.matches(query)).select("doc_id")

    return run


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_PHRASE = "list_contains(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '{}')"


def _search_sql(cond: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE {cond}"


def _has(w: str) -> str:
    return f"list_contains(t, '{w}')"


#: Queries of the inverted index, and what each asks of the folded tokens t.
INDEXED = (
    ("für", "list_contains(t, 'fur')"),
    ("ción* NOT of", "len(list_filter(t, lambda x: starts_with(x, 'cion'))) > 0 AND NOT list_contains(t, 'of')"),
    ('"of the"', _PHRASE.format("of the")),
    ("NEAR(that wher, 3)", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'that' AND list_contains(t[greatest(i - 4, 1):i + 4], 'wher'))) > 0"),
    ("(reed OR éque) that", "(list_contains(t, 'reed') OR list_contains(t, 'eque')) AND list_contains(t, 'that')"),
    ("e*", "len(list_filter(t, lambda x: starts_with(x, 'e'))) > 0"),
)


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """An index of all documents, built in three batches of which two are merged, asked several queries."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("summary"))
    index = SearchIndex(s, shared_path(s, "search"), columns=("summary",), buckets=16)
    for k in range(3):
        index.add(docs.where(F.pmod("doc_id", F.lit(3)) == k), "doc_id")
        if k == 1:
            index.merge(2)
    found = [index.keys(q).select(F.lit(q).alias("query"), F.col("key").alias("doc_id")) for q, _ in INDEXED]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


INDEXED_SQL = "WITH tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT '{q}' AS query, doc_id FROM tok WHERE {cond}" for q, cond in INDEXED
)


def _secret_scan(s, d):
    docs = table(s, d, "documents").select("doc_id", secrets.first_secret(F.col("text"), PATTERNS).alias("pattern"))
    return docs.where("pattern <> ''")


SECRET_SQL = "SELECT doc_id, pattern FROM (SELECT doc_id, CASE " + " ".join("WHEN regexp_matches(text, '{0}') THEN '{0}'".format(p.replace("'", "''")) for p in PATTERNS) + " END AS pattern FROM documents) WHERE pattern IS NOT NULL"


def _redact(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(secrets.redact_lines(F.col("text"), PATTERNS), 256).alias("redacted_sha256"))


REDACT_SQL = "SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{}') THEN '{}' ELSE l END), chr(10))) AS redacted_sha256 FROM documents".format("|".join(PATTERNS).replace("'", "''"), secrets.REDACTED)


def _hints(s, d):
    j = changes(s, d).withColumns({n: F.lit("") for n in ("branch", "agent_id", "diff_stat", "created_at")}).withColumn("clock_tamper_warning", F.lit(False))
    return render.file_hints(j).select("file_path", "path", F.sha2("content", 256).alias("content_sha256"))


def _escape_sql(c: str) -> str:
    for raw, safe in text.ESCAPES:
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


_TIME = "strftime(to_timestamp(recorded_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
HINTS_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {NEW}) AS rank FROM {CHANGES_SQL}),
 l AS (SELECT file_path, rank, '## ' || {_TIME} || chr(10) || '- source: ' || source || CASE WHEN commit_hash <> '' THEN ' · commit: `' || left(commit_hash, 8) || '`' ELSE ' · uncommitted' END
   || chr(10) || chr(10) || {_escape_sql("summary")} || chr(10) || CASE WHEN reason <> '' THEN chr(10) || '_why: ' || {_escape_sql("reason")} || '_' || chr(10) ELSE '' END || chr(10) AS x FROM r WHERE rank <= 20)
SELECT file_path, '{text.STATE_DIR}/' || file_path || '.md' AS path, sha256('# ' || file_path || chr(10) || chr(10) || string_agg(x, '' ORDER BY rank)) AS content_sha256 FROM l GROUP BY file_path"""


def _verify_rendered(s, d):
    want = _hints(s, d).select("path", F.col("content_sha256").alias("content"))
    n = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int")
    disk = want.where(n % 9 != 0).withColumn("content", F.when(n % 7 == 0, "edited").otherwise(F.col("content")))
    return render.diverged(want, disk)


def _sessions(s, d):
    calls = table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("tool"))
    used = sessions.tools_used(calls)
    listed = (("assistant", "a"), ("system", "s"), ("tool", "t"), ("user", "u"))
    found = sessions.suggestions(s, used, catalogue=listed)
    return used.join(found, "session", "left").select("session", F.array_join("tools", ",").alias("tools"), F.col("rank").cast("int").alias("rank"), "tool")


SESSIONS_SQL = """
WITH u AS (SELECT conv_id AS session, string_agg(DISTINCT role, ',' ORDER BY role) AS tools FROM conversations GROUP BY 1),
 c(tool) AS (VALUES ('assistant'), ('system'), ('tool'), ('user')),
 s AS (SELECT session, tool, row_number() OVER (PARTITION BY session ORDER BY tool) AS rank FROM u, c WHERE NOT list_contains(string_split(tools, ','), tool))
SELECT u.session, tools, rank::INT AS rank, tool FROM u LEFT JOIN s ON s.session = u.session AND rank <= 3"""


def _scalars(s, d):
    li = table(s, d, "lineitem")
    raw = F.format_string("+%d -%d", F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    raw = F.when(F.col("l_linenumber") == 6, "binary").when(F.col("l_linenumber") == 5, F.format_string("+%d", "l_linenumber")).otherwise(raw)
    st = text.diff_stat(raw)
    return li.select("l_orderkey", "l_linenumber", st["add"].alias("add"), st["del"].alias("del"))


SCALARS_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (5, 6) THEN l_quantity::INT END AS add, CASE WHEN l_linenumber NOT IN (5, 6) THEN l_linenumber END AS del FROM lineitem"""


#: By page: what stands in for a commit, and for a path, and whether it is valid.
COMMITS = (("md5(html)", "true"), ("'xyz1'", "false"), ("left(md5(html), 3)", "false"), ("''", "true"), ("concat(md5(html), md5(url))", "true"), ("concat(md5(html), md5(url), '0')", "false"))
PATHS = (("url", "true"), ("concat('/', url)", "false"), ("concat('../', url)", "false"), ("concat(url, '/../../../../../../../../../../../../x')", "false"), ("concat('a/../', url)", "true"), ("''", "false"), ("concat('./', url)", "true"))


def _by_page(cases, k: int) -> str:
    return "CASE " + " ".join(f"WHEN page_id % {len(cases)} = {i} THEN {c[k]}" for i, c in enumerate(cases)) + " END"


def _text_scalars(s, d):
    p = table(s, d, "pages")
    return p.select(
        "page_id", F.sha2(text.md_escape("html"), 256).alias("escaped_sha256"), F.sha2(text.like_escape("html"), 256).alias("like_escaped_sha256"), text.short_hash(F.sha2("html", 256)).alias("short"),
        text.file_key(F.concat("url", F.lit("/index.ts"))).alias("key"), text.extension("url").alias("ext"), text.commitish(F.expr(_by_page(COMMITS, 0))).alias("commitish"),
        text.valid_path(F.expr(_by_page(PATHS, 0))).alias("valid"), F.sha2("html", 256).alias("payload_sha256"), crypto.repository_id(F.col("url")).alias("repository_id"),
    )


TEXT_SQL = f"""SELECT page_id, sha256({_escape_sql("html")}) AS escaped_sha256, sha256(replace(replace(replace(html, '\\', '\\\\'), '%', '\\%'), '_', '\\_')) AS like_escaped_sha256, left(sha256(html), 8) AS short,
 url AS key, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext, {_by_page(COMMITS, 1)} AS commitish, {_by_page(PATHS, 1)} AS valid, sha256(html) AS payload_sha256, left(sha256(url), 32) AS repository_id FROM pages"""


def _timestamps(s, d):
    e = table(s, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 5
    shown = F.when(k == 0, at.cast("string")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(F.date_format("ts", "yyyy-MM"))
    return e.select("event_id", text.parse_timestamp(shown).alias("seconds"), text.format_time(at).alias("shown"))


TIMES_SQL = """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000000 ELSE epoch_us(ts) // 1000000 END AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM events"""


def _aliases(s, d):
    return codegraph.resolve_specifiers(table(s, d, "pages").select("page_id", F.col("url").alias("specifier")), ALIASES)


#: A target is cleaned as a path: one slash between its parts, none at its end.
ALIAS_SQL = "SELECT page_id, url AS specifier, CASE " + " ".join(
    f"WHEN starts_with(url, '{p[:-1]}') THEN regexp_replace(regexp_replace('{t[:-1]}' || substr(url, {len(p)}), '/+', '/', 'g'), '/$', '')" for p, t in sorted(ALIASES.items(), key=lambda x: -len(x[0]))
) + " END AS resolved FROM pages"


def _alias_table(s, d):
    """Specifiers of orders by a table of a pattern or two per customer, in two projects."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    project = lambda k: F.concat(F.lit("p"), (F.col(k) % 2).cast("string")).alias("project")
    key = F.col("c_custkey").cast("string")
    plain = c.select(project("c_custkey"), F.concat(F.lit("@"), key, F.lit("/*")).alias("pattern"), F.concat(F.lit("src/"), F.col("c_nationkey").cast("string"), F.lit("/./*")).alias("target"))
    longer = c.where("c_custkey % 7 = 0").select(project("c_custkey"), F.concat(F.lit("@"), key, F.lit("/sub/*")).alias("pattern"), F.lit("lib//*").alias("target"))
    whole = c.where("c_custkey % 11 = 0").select(project("c_custkey"), F.concat(F.lit("@"), key, F.lit("/sub/b")).alias("pattern"), F.lit("one/./file").alias("target"))
    end = F.when(F.col("o_orderkey") % 3 == 0, "/a").when(F.col("o_orderkey") % 3 == 1, "/sub/b").otherwise("/../c")
    specs = o.select("o_orderkey", F.concat(F.lit("p"), (F.col("o_custkey") % 2).cast("string")).alias("project"), F.concat(F.lit("@"), F.col("o_custkey").cast("string"), end).alias("specifier"))
    return codegraph.resolve_aliases(specs, plain.union(longer).union(whole)).select("o_orderkey", "specifier", "resolved")


ALIAS_TABLE_SQL = """SELECT o_orderkey, '@' || o_custkey || e AS specifier, CASE WHEN c_custkey IS NULL THEN NULL
  WHEN o_orderkey % 3 = 1 AND o_custkey % 11 = 0 THEN 'one/./file' WHEN o_orderkey % 3 = 1 AND o_custkey % 7 = 0 THEN 'lib/b' WHEN o_orderkey % 3 = 2 THEN 'src/c' ELSE 'src/' || c_nationkey || e END AS resolved
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/sub/b' ELSE '/../c' END AS e FROM orders) LEFT JOIN customer ON c_custkey = o_custkey"""


def _payloads(s, d):
    """Turns of conversations as signed rows: texts with quotes, control signs and HTML, signed by the real payload."""
    c = table(s, d, "conversations")
    odd = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a\"b\\c<d>&e\tf\n"), F.col("text"))).otherwise(F.col("text"))
    rows = c.select(
        "conv_id", "turn", F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("file_path"), F.col("role").alias("source"), odd.alias("summary"), F.col("turn").cast("long").alias("recorded_at"),
        *(F.lit("").alias(n) for n in ("prev_hmac", "branch", "reason", "diff_stat", "diff_hash", "agent_id")),
    )
    return rows.select("conv_id", "turn", crypto.hmac_sha256(crypto.signed_payload(), KEY).alias("hmac"))


def _json_sql(c: str) -> str:
    out = f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"
    short = {10: "n", 13: "r", 9: "t", 8: "b", 12: "f"}
    for n in [*range(1, 32), *map(ord, "<>&\u2028\u2029")]:
        out = f"replace({out}, chr({n}), '\\{short.get(n, f'u{n:04x}')}')"
    return f"'\"' || {out} || '\"'"


PAYLOAD_SQL = "SELECT conv_id, turn, " + _hmac_sql(
    """'{"prev_hmac":"","file_path":"c/' || conv_id || '","branch":"","source":"' || role || '","summary":' || """
    + _json_sql("CASE WHEN turn % 3 = 0 THEN 'a\"b\\c<d>&e' || chr(9) || 'f' || chr(10) || text ELSE text END")
    + """ || ',"reason":"","diff_stat":"","diff_hash":"","agent_id":"","recorded_at":' || turn || '}'"""
) + " AS hmac FROM conversations"


def _scripts(s, d):
    """Symbols in the script blocks of pages, by the component parser."""
    pages = table(s, d, "pages").select(F.format_string("p/%d.svelte", "page_id").alias("file_path"), F.col("html").alias("content"))
    parsed = parse_files(pages)
    return parsed.select("file_path", "status", F.size("symbols").alias("n_symbols"), F.size("imports").alias("n_imports"))


#: A source per part, and the symbols that it has: name, kind, first and last line, signature. {k} and {n}: key and size.
TS_SOURCE = "import {{ a }} from './m{n}';\nexport const N{k} = {n};\nexport function f{k}(x: number) {{\n  const inner = x;\n  return inner;\n}}\nexport class K{k} {{\n  m{n}(): void {{\n  }}\n}}\n"
GO_SOURCE = "package p\n\ntype T{k} struct {{\n\tA int\n}}\n\nfunc F{k}(n int) error {{ return nil }}\n"
TS_SYMBOLS = (("N{k}", "const", 2, 2, "export const N{k} = {n};"), ("f{k}", "func", 3, 6, "export function f{k}(x: number)"), ("K{k}", "type", 7, 10, "export class K{k}"), ("m{n}", "method", 8, 9, "m{n}(): void"))
GO_SYMBOLS = (("T{k}", "type", 3, 5, "type T{k} struct{{...}}"), ("F{k}", "func", 7, 7, "func F{k}(n int) (error)"))


def _filled(pattern: str) -> str:
    """A pattern as an SQL expression over p_partkey and p_size, for both engines."""
    parts = re.split(r"\{(k|n)\}", pattern.replace("{{", "\1").replace("}}", "\2"))
    text_of = lambda x: "'" + x.replace("\1", "{").replace("\2", "}").replace("'", "''") + "'"
    names = {"k": "CAST(p_partkey AS VARCHAR(20))", "n": "CAST(p_size AS VARCHAR(20))"}
    return "concat(" + ", ".join(names[x] if i % 2 else text_of(x) for i, x in enumerate(parts)) + ")"


def _parse_parts(s, d):
    """Symbols of a source per part, by the Go and TypeScript parsers."""
    def source(pattern: str):
        parts = re.split(r"\{(k|n)\}", pattern.replace("{{", "\1").replace("}}", "\2"))
        cols = {"k": F.col("p_partkey").cast("string"), "n": F.col("p_size").cast("string")}
        return F.concat(*(cols[x] if i % 2 else F.lit(x.replace("\1", "{").replace("\2", "}")) for i, x in enumerate(parts)))

    even = F.col("p_partkey") % 2 == 0
    rows = table(s, d, "part").select(
        F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.when(even, ".ts").otherwise(".go")).alias("file_path"), F.when(even, source(TS_SOURCE)).otherwise(source(GO_SOURCE)).alias("content")
    )
    return symbols_of(parse_files(rows))


PARSE_SQL = " UNION ALL ".join(
    f"SELECT {_filled(n)} AS name, '{kind}' AS kind, concat('src/', p_partkey, '{ext}') AS file_path, {a} AS line_start, {b} AS line_end, {_filled(sig)} AS signature FROM part WHERE p_partkey % 2 = {odd}"
    for odd, ext, rows in ((0, ".ts", TS_SYMBOLS), (1, ".go", GO_SYMBOLS)) for n, kind, a, b, sig in rows
)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Skew flags of a finite stream of events, batch by batch as of a live one."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    src = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    rows = src.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("recorded_at"))
    path = shared_path(s, "skew")
    flag_skew(rows, f"{path}/table", f"{path}/state").awaitTermination()
    return skew_flags_so_far(s, f"{path}/table").select("id", "recorded_at", "skewed")


STREAM_SQL = """SELECT id, recorded_at, coalesce(recorded_at <> 0 AND m <> 0 AND recorded_at < m - 5, false) AS skewed FROM (SELECT id, recorded_at, max(recorded_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT event_id AS id, epoch_us(ts) // 1000000 AS recorded_at FROM events))"""


def _effective(s, d):
    return reconcile.effective_commits(_events(s, d), _claims(s, d)).select("id", "file_path", "effective_commit")


EFFECTIVE_SQL = f"""WITH c AS {CLAIMS_SQL}, j AS {CHANGES_SQL}
SELECT j.id, j.file_path, CASE WHEN j.commit_hash <> '' THEN j.commit_hash WHEN source = 'agent' THEN coalesce((SELECT arg_min(c.commit_hash, claim_seq) FROM c WHERE c.file_path = j.file_path AND as_of_id >= j.id), '') ELSE '' END AS effective_commit FROM j"""

_ALL: dict[str, tuple[Query, str | None]] = {
    "changes_in_range": (lambda s, d: journal.in_range(_events(s, d), SINCE, UNTIL).select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} WHERE recorded_at BETWEEN {SINCE} AND {UNTIL} ORDER BY {NEW} LIMIT 50"),
    "changes_in_range_file": (lambda s, d: journal.in_range(_events(s, d), SINCE, UNTIL, "u/7").select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} WHERE recorded_at BETWEEN {SINCE} AND {UNTIL} AND file_path = 'u/7' ORDER BY {NEW} LIMIT 50"),
    "file_history": (lambda s, d: journal.file_history(_events(s, d), "u/3").select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} WHERE file_path = 'u/3' ORDER BY {NEW} LIMIT 20"),
    "recent_changes": (lambda s, d: journal.recent(_events(s, d)).select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} ORDER BY {NEW} LIMIT 20"),
    "file_history_top20": (lambda s, d: journal.top_per_file(_events(s, d)).select("file_path", "id", F.col("rank").cast("long").alias("rank")), f"SELECT file_path, id, rank FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY {NEW}) AS rank FROM {CHANGES_SQL}) WHERE rank <= 20"),
    "commit_rows": (lambda s, d: journal.of_commit(_events(s, d), "c3").select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} WHERE commit_hash = 'c3'"),
    "all_changes": (lambda s, d: journal.all_changes(_events(s, d)).select(*COLS), f"SELECT {C} FROM {CHANGES_SQL}"),
    "agent_rows_of_commit": (lambda s, d: journal.agent_rows(_events(s, d), "u/52", "c3").select(*COLS), f"SELECT {C} FROM {CHANGES_SQL} WHERE source = 'agent' AND commit_hash = 'c3' AND file_path = 'u/52'"),
    "files_with_agent_rows": (lambda s, d: journal.files_with_agent_rows(_events(s, d), _events(s, d).select("file_path", "commit_hash").distinct()).select("file_path", "commit_hash"), f"SELECT DISTINCT file_path, commit_hash FROM {CHANGES_SQL} WHERE source = 'agent'"),
    "files_with_pending_rows": (lambda s, d: journal.files_with_pending_rows(_events(s, d), _events(s, d).select("file_path").distinct()), f"SELECT DISTINCT file_path FROM {CHANGES_SQL} WHERE source = 'agent' AND commit_hash = ''"),
    "files_with_history": (lambda s, d: journal.files_with_history(_events(s, d)), f"SELECT DISTINCT file_path FROM {CHANGES_SQL}"),
    "pending_by_file": (lambda s, d: journal.pending_by_file(_events(s, d)), f"SELECT file_path, count(*) AS n_pending FROM {CHANGES_SQL} WHERE commit_hash = '' GROUP BY 1"),
    "journal_status": (lambda s, d: journal.status(_events(s, d)), f"SELECT count(*) AS n_changes, count(*) FILTER (WHERE commit_hash = '') AS n_pending, count(DISTINCT file_path) AS n_files, max(recorded_at) AS last_recorded_at FROM {CHANGES_SQL}"),
    "last_hmac": (lambda s, d: journal.last_hmac(_orders_journal(s, d)), "SELECT CASE WHEN max(o_orderkey) % 101 = 0 THEN '' ELSE arg_max(h, o_orderkey) END AS hmac FROM (SELECT o_orderkey, " + _hmac_sql("o_orderkey || '|' || o_orderstatus || '|' || (epoch_us(o_orderdate) // 1000000)") + " AS h FROM orders)"),
    "latest_per_key": (lambda s, d: journal.latest_per_key(_events(s, d).select(F.col("file_path").alias("key"), F.col("summary").alias("value"), F.col("id").alias("seq"))), f"SELECT file_path AS key, arg_max(summary, id) AS value FROM {CHANGES_SQL} GROUP BY 1"),
    "pre_commit_gate": (lambda s, d: reconcile.unexplained(_staged(s, d), _events(s, d)), f"SELECT DISTINCT 'u/' || user_id AS file_path FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) AND 'u/' || user_id NOT IN (SELECT file_path FROM {CHANGES_SQL} WHERE source = 'agent' AND commit_hash = '')"),
    "claim_effective_commit": (_effective, EFFECTIVE_SQL),
    "commit_coverage": (_coverage, COVERAGE_SQL),
    "fallback_rows": (lambda s, d: reconcile.fallback_rows(_coverage(s, d), 1), f"SELECT file_path, commit_hash, '' AS branch, 'fallback' AS source, CASE WHEN verifiable THEN '{reconcile.SUMMARIES['uncovered']}' ELSE '{reconcile.SUMMARIES['unverifiable'].replace(chr(39), chr(39) * 2)}' END AS summary, 1::BIGINT AS recorded_at FROM ({COVERAGE_SQL}) WHERE NOT covered"),
    "chain_verify": (lambda s, d: integrity.findings(_orders_journal(s, d), KEY, F.col("payload")), CHAIN_SQL),
    "clock_skew_flags": (_skew, SKEW_SQL),
    "merkle_root": (lambda s, d: integrity.merkle_root(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h")), "id", "h"), _merkle_sql("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, sha256(o_orderkey::VARCHAR) AS h FROM orders")),
    "merkle_per_group": (lambda s, d: integrity.merkle_root(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h")), "id", "h", ("o_custkey",)), _merkle_sql("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256(o_orderkey::VARCHAR) AS h FROM orders", "o_custkey")),
    "changelog_run_heads": (lambda s, d: render.changelog_heads(_events(s, d)).where("head").select("id", "commit_hash"), f"SELECT id, commit_hash FROM (SELECT id, commit_hash, lag(commit_hash, 1, '') OVER (ORDER BY {NEW}) AS p FROM (SELECT * FROM {CHANGES_SQL} ORDER BY {NEW} LIMIT 100)) WHERE commit_hash <> p"),
    "render_file_notes": (_hints, HINTS_SQL),
    "render_verify": (_verify_rendered, f"SELECT path FROM ({HINTS_SQL}) WHERE regexp_extract(path, '(\\d+)\\.md$', 1)::INT % 9 = 0 OR regexp_extract(path, '(\\d+)\\.md$', 1)::INT % 7 = 0"),
    "hub_files": (lambda s, d: codegraph.hubs(page_imports(s, d)), f"SELECT imported_path, count(*) AS dependents FROM {IMPORTS_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "importers_of_hub": (lambda s, d: page_imports(s, d).join(F.broadcast(codegraph.hubs(page_imports(s, d), 1)), "imported_path").select("file_path"), f"SELECT file_path FROM {IMPORTS_SQL} WHERE imported_path = (SELECT imported_path FROM {IMPORTS_SQL} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    "imports_of_file": (lambda s, d: page_imports(s, d).join(F.broadcast(page_imports(s, d).agg(F.min("file_path").alias("file_path"))), "file_path").select("imported_path"), f"SELECT imported_path FROM {IMPORTS_SQL} WHERE file_path = (SELECT min(file_path) FROM {IMPORTS_SQL})"),
    "distinct_importers": (lambda s, d: page_imports(s, d).groupBy("imported_path").agg(F.countDistinct("file_path").alias("files")), f"SELECT imported_path, count(DISTINCT file_path) AS files FROM {IMPORTS_SQL} GROUP BY 1"),
    "linked_imports": (_linked, LINKED_SQL),
    "dependents": (lambda s, d: codegraph.dependents(_ts_imports(s, d), _ts_pages(s, d).select("file_path")), f"SELECT f.file_path, i.file_path AS importer FROM {TS_SQL} f JOIN {TS_IMPORTS_SQL} i ON {_KEY.format(c='f.file_path')} = i.imported_path"),
    "all_indexed_files": (lambda s, d: codegraph.indexed_files(part_symbols(s, d), page_imports(s, d)), f"SELECT file_path FROM {SYMBOLS_SQL} UNION SELECT file_path FROM {IMPORTS_SQL}"),
    "symbol_prefix": (lambda s, d: codegraph.find_symbol(part_symbols(s, d), "RED", 20), f"SELECT * FROM {SYMBOLS_SQL} WHERE lower(name) LIKE 'red%' ORDER BY length(name), file_path, line_start, name, line_end LIMIT 20"),
    "symbols_of_file": (lambda s, d: codegraph.symbols_of_file(part_symbols(s, d), "Brand#11"), f"SELECT * FROM {SYMBOLS_SQL} WHERE file_path = 'Brand#11'"),
    "index_summary": (lambda s, d: codegraph.summary(part_symbols(s, d), page_imports(s, d)).drop("language_counts"), f"SELECT (SELECT count(DISTINCT file_path) FROM {SYMBOLS_SQL}) AS file_count, (SELECT count(*) FROM {SYMBOLS_SQL}) AS symbol_count, (SELECT count(*) FROM {IMPORTS_SQL}) AS import_count"),
    "language_counts": (lambda s, d: render.language_of_files(_ts_pages(s, d).select("file_path").distinct()).groupBy("language").count().withColumnRenamed("count", "files"), f"SELECT CASE WHEN file_path LIKE '%.ts' THEN 'typescript' ELSE 'svelte' END AS language, count(DISTINCT file_path) AS files FROM {TS_SQL} GROUP BY 1"),
    "index_drift": (_drift, DRIFT_SQL),
    "search_term": (_search("reed"), _search_sql(_has("reed"))),
    "search_and": (_search("that wher"), _search_sql(f"{_has('that')} AND {_has('wher')}")),
    "search_or_not": (_search("(reed OR wher) NOT that"), _search_sql(f"({_has('reed')} OR {_has('wher')}) AND NOT {_has('that')}")),
    "search_prefix": (_search("oftht*"), _search_sql("len(list_filter(t, lambda x: starts_with(x, 'oftht'))) > 0")),
    "search_phrase": (_search('"of the"'), _search_sql(_PHRASE.format("of the"))),
    "search_index": (_indexed, INDEXED_SQL),
    "secret_scan": (_secret_scan, SECRET_SQL),
    "redact_lines": (_redact, REDACT_SQL),
    "diffstat_parse": (_scalars, SCALARS_SQL),
    "text_scalars": (_text_scalars, TEXT_SQL),
    "timestamps": (_timestamps, TIMES_SQL),
    "alias_longest_prefix": (_aliases, ALIAS_SQL),
    "alias_table": (_alias_table, ALIAS_TABLE_SQL),
    "signed_payloads": (_payloads, PAYLOAD_SQL),
    "session_context": (_sessions, SESSIONS_SQL),
    "script_blocks": (_scripts, None),
    "parse_symbols": (_parse_parts, PARSE_SQL),
    "stream_skew_flags": (_stream, STREAM_SQL),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql is not None}
