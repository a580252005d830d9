"""Secrets in texts, and weak candidates linked to the other parts of a credential; DataFrame functions only.

Three patterns report on their own: assignments to a secret's name, access identifiers, long hexadecimal runs. Logins,
mixed tokens and endpoints are too common for that. They are parts of a credential: an identifier (access or
login), a secret (assignment, hexadecimal run or mixed token) and an endpoint. A weak part is reported where its scope,
`reach` code points to either side, holds its complements:

- a mixed token: an access identifier, or a login and an endpoint;
- a login: an assignment or hexadecimal run, or a mixed token and an endpoint;
- an endpoint: an identifier and a secret, one of them not weak.

Texts never leave their task. A match is found with the text before it, as lengths; their running sum places it.
Parts meet by an interval join over bins of a text: a bin keeps, for each sort of part, where its first one starts and
its last one ends, which decides exactly whether a scope that ends within the bin holds one; so a bin
joins a scope once, however many parts it has.

A null text is empty. Spans are half open, in code points. Every row gets an answer; rows that repeat doc_id
and text get the same one and are scanned once for links. A null doc_id is an identifier like others.
No rows: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strayrows.llm.registry import query, table
from strayrows.staging import stage


def either(*words: str) -> str:
    """Words with each ASCII letter in either case; other characters as they are."""
    return "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words) + ")"


SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = either("password", "passwd", "secret", "token", "api_?key") + SET + "([A-Za-z0-9+/_.=-]+)"
#: The shortest that counts is part of these two patterns: a run that is too short holds no longer one.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ENDPOINT = r"""(?:https?|ftp|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+"""
LOGIN = either("username", "user", "login", "client_id", "account") + SET + "[A-Za-z0-9._@+-]{3,}"
MIXED = "[A-Za-z0-9+/_-]{20,}"
#: In this order a match of all patterns at once is told what it is.
ALL = [("assign", ASSIGN.replace("([", "(?:[")), ("access", ACCESS), ("hex", HEX), ("endpoint", ENDPOINT), ("login", LOGIN), ("mixed", MIXED)]
KINDS = [k for k, _ in ALL]
BASE, WEAK = KINDS[:3], KINDS[3:]
ANY = "|".join(p for _, p in ALL)


def _matches(text: Column, pattern: str, kind) -> Column:
    """(kind, gap, size) of each match; gap is the length of what lies between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda b, m: F.struct(kind(m).alias("kind"), F.length(b).alias("gap"), F.length(m).alias("size")))
    return F.filter(pairs, lambda x: x["size"].isNotNull())  # after the last match lies a piece without one


def _fixed(kind: str):
    return lambda m: F.lit(kind)


def _assign(m: Column) -> Column:
    return F.when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6, "assign")


def _weak(m: Column) -> Column:
    """What a match of ANY is, if weak; null for the others, which only keep their place."""
    out = F.when(m.rlike("^(?:" + "|".join(p for _, p in ALL[:3]) + ")"), F.lit(None).cast("string"))
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    return out.when(m.rlike("^" + ENDPOINT), "endpoint").when(m.rlike("^" + LOGIN), "login").when(mixed, "mixed")


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,gap:int,size:int>>")


def _scanned(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, key, assign, access, hex, weak): matches of every row; key is null without any."""
    t = F.col("t")
    sets = t.contains(":") | t.contains("=")
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).select(
        "doc_id",
        "t",
        F.when(sets & t.rlike(ASSIGN), _matches(t, ASSIGN, _assign)).otherwise(_none()).alias("assign"),
        F.when(t.contains("AKIA"), _matches(t, ACCESS, _fixed("access"))).otherwise(_none()).alias("access"),
        F.when(t.rlike(HEX), _matches(t, HEX, _fixed("hex"))).otherwise(_none()).alias("hex"),
        # Without an assignment or anything of the base, weak parts have no complement: only a login makes do with weak ones.
        F.when(sets & t.rlike(LOGIN) | t.contains("AKIA") | t.rlike(HEX) | sets & t.rlike(ASSIGN), _matches(t, ANY, _weak))
        .otherwise(_none())
        .alias("weak"),
    )
    some = F.size("assign") + F.size("access") + F.size("hex") + F.size("weak") > 0
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), t).cast("binary"), 256)
    return rows.select("doc_id", F.when(some, key).alias("key"), "assign", "access", "hex", "weak")


def _placed(scanned: DataFrame) -> DataFrame:
    """(key, kind, begin, until) of all parts, weak ones too."""
    one = scanned.where("key IS NOT NULL").groupBy("key").agg(*[F.first(c).alias(c) for c in ("assign", "access", "hex", "weak")])
    lists = F.array(*[F.struct(F.lit(c).alias("pass"), F.col(c).alias("found")) for c in ("assign", "access", "hex", "weak")])
    each = (
        one.select("key", F.inline(lists)).select("key", "pass", F.posexplode("found").alias("i", "m")).select("key", "pass", "i", "m.kind", "m.gap", "m.size")
    )
    before = Window.partitionBy("key", "pass").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum(F.col("gap") + F.col("size")).over(before)
    return each.withColumn("until", until).where("kind IS NOT NULL").select("key", "kind", (F.col("until") - F.col("size")).alias("begin"), "until")


def linked(parts: DataFrame, reach: int = 200) -> DataFrame:
    """The weak ones of `parts` (key, kind, begin, until) whose complements lie in their scope."""
    bins = lambda a, b: F.explode(F.sequence((a / reach).cast("bigint"), ((b - 1) / reach).cast("bigint")))
    held = (
        parts.withColumn("bin", bins(F.col("begin"), F.col("until")))
        .groupBy("key", "bin", "kind")
        .agg(F.min("begin").alias("first"), F.max("until").alias("last"))
        .groupBy("key", "bin")
        .agg(F.collect_list(F.struct("kind", "first", "last")).alias("held"))  # six kinds at most
    )
    low, high = F.greatest(F.col("begin") - reach, F.lit(0)), F.col("until") + reach
    scopes = parts.where(F.col("kind").isin(WEAK)).withColumn("bin", bins(low, high))
    # A scope is longer than a bin, so it ends at one side of a bin at most.
    inside = F.filter("held", lambda p: (p["first"] < high) & (p["last"] > low))
    met = scopes.join(held, ["key", "bin"]).select("key", "kind", "begin", "until", F.explode(inside).alias("p"))
    has = {k: F.max(F.col("p.kind") == k).alias(f"has_{k}") for k in KINDS}
    flags = met.groupBy("key", "kind", "begin", "until").agg(*has.values())
    firm_secret, any_id = F.col("has_assign") | F.col("has_hex"), F.col("has_access") | F.col("has_login")
    complete = (
        F.when(F.col("kind") == "mixed", F.col("has_access") | F.col("has_login") & F.col("has_endpoint"))
        .when(F.col("kind") == "login", firm_secret | F.col("has_mixed") & F.col("has_endpoint"))
        .otherwise(F.col("has_access") & (firm_secret | F.col("has_mixed")) | any_id & firm_secret)
    )
    return flags.where(complete).select("key", "kind", "begin", "until")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, spans) for every row: an array of (begin, rank, kind, until) in order; rank is the kind's place in KINDS."""
    scanned = stage(_scanned(docs, id, text), "scanned")
    parts = stage(_placed(scanned), "parts")
    spans = parts.where(F.col("kind").isin(BASE)).unionByName(linked(parts, reach))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by_key = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", rank.alias("rank"), "kind", "until"))).alias("spans"))
    nothing = F.array().cast(by_key.schema["spans"].dataType)
    with_key = scanned.where("key IS NOT NULL").select("doc_id", "key").join(by_key, "key", "left")
    return with_key.select("doc_id", F.coalesce("spans", nothing).alias("spans")).unionByName(
        scanned.where("key IS NULL").select("doc_id", nothing.alias("spans"))
    )


def listed(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:begin:until of spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["until"].cast("string"))), ",")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql(reach: int = 200) -> str:
    passes = " UNION ALL ".join(
        f"SELECT r, '{name}' AS pass, unnest(regexp_extract_all(t, {_quoted(p)})) AS m, unnest(regexp_split_to_array(t, {_quoted(p)})) AS b, "
        f"generate_subscripts(regexp_split_to_array(t, {_quoted(p)}), 1) AS i FROM source"
        for name, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("weak", ANY))
    )
    base = "|".join(p for _, p in ALL[:3])
    near = lambda *kinds: (
        f"EXISTS (SELECT 1 FROM parts AS p WHERE p.r = w.r AND p.kind IN ({', '.join(repr(k) for k in kinds)}) "
        f"AND p.a < w.z + {reach} AND p.z > greatest(w.a - {reach}, 0))"
    )
    return f"""
WITH source AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({passes}),
placed AS (
  SELECT r, pass, m, sum(length(b) + length(m)) OVER (PARTITION BY r, pass ORDER BY i) AS z FROM matches WHERE m IS NOT NULL
), parts AS (
  SELECT * FROM (
    SELECT r, (z - length(m))::BIGINT AS a, z::BIGINT AS z, CASE pass
      WHEN 'assign' THEN CASE WHEN length(regexp_extract(m, {_quoted(ASSIGN)}, 1)) >= 6 THEN 'assign' END
      WHEN 'weak' THEN CASE WHEN regexp_matches(m, {_quoted("^(?:" + base + ")")}) THEN NULL
        WHEN regexp_matches(m, {_quoted("^" + ENDPOINT)}) THEN 'endpoint' WHEN regexp_matches(m, {_quoted("^" + LOGIN)}) THEN 'login'
        WHEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 'mixed' END
      ELSE pass END AS kind
    FROM placed) WHERE kind IS NOT NULL
), spans AS (
  SELECT * FROM parts WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL
  SELECT * FROM parts AS w WHERE kind = 'mixed' AND ({near("access")} OR {near("login")} AND {near("endpoint")})
  UNION ALL
  SELECT * FROM parts AS w WHERE kind = 'login' AND ({near("assign", "hex")} OR {near("mixed")} AND {near("endpoint")})
  UNION ALL
  SELECT * FROM parts AS w WHERE kind = 'endpoint'
    AND ({near("access")} AND {near("assign", "hex", "mixed")} OR {near("login")} AND {near("assign", "hex")})
), ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'endpoint', 'login', 'mixed'], kind) AS k FROM spans),
found AS (
  SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 4) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans
  FROM ranked GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM source LEFT JOIN found USING (r)
"""


SQL = _sql()


@query("op13_secret_scan", SQL)
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("spans"), BASE).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
