"""Instant answers to query strings that are built by rule from whole tables, with SQL twins that compute the answers from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import instant, text
from quern.plans import sqltext as S
from quern.runtime import table

PAIRS = [("km", "miles", "length"), ("feet", "m", "length"), ("kg", "lbs", "weight"), ("oz", "grams", "weight"), ("gb", "mb", "data"), ("mb", "kb", "data"), ("knots", "mph", "velocity"), ("celsius", "fahrenheit", ""), ("fahrenheit", "celsius", "")]
MONEY = [("usd", "eur"), ("gbp", "jpy"), ("$", "inr"), ("euros", "cad"), ("btc", "usd"), ("eth", "sol")]
CLOCKS = [("utc", "tokyo"), ("est", "london"), ("jst", "new delhi"), ("pst", "utc"), ("cet", "sydney")]


def _cycle(items, number):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (number % len(items) + 1).cast("int"))


def unit_answers(spark, d):
    """A conversion for every part: its size, and the pair of units that its key falls on."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("size"))
    q = F.concat_ws(" ", F.col("size").cast("string"), _cycle([a for a, _, _ in PAIRS], F.col("p_partkey")), F.lit("to"), _cycle([b for _, b, _ in PAIRS], F.col("p_partkey")))
    return p.select("p_partkey", q.alias("query")).withColumn("value", instant.unit(F.col("query")))


def money_answers(spark, d):
    """A sum of money for every customer's balance."""
    c = table(spark, d, "customer").select("c_custkey", F.abs(F.col("c_acctbal").cast("decimal(15,2)")).cast("string").alias("v"))
    q = F.concat_ws(" ", "v", _cycle([a for a, _ in MONEY], F.col("c_custkey")), F.lit("in"), _cycle([b for _, b in MONEY], F.col("c_custkey")))
    return c.select("c_custkey", q.alias("query")).withColumn("value", instant.money(F.col("query")))


def arithmetic_answers(spark, d):
    """An expression of every part's numbers."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"), F.col("p_retailprice").cast("decimal(15,2)").alias("r"))
    q = F.concat(F.lit("("), "r", F.lit(" + "), "s", F.lit(") * 2 ^ 2 ^ 1 - -"), "s", F.lit(" / 4 + sqrt("), "s", F.lit(") + 10% of "), "s")
    return p.select("p_partkey", q.alias("query")).withColumn("value", text.round_half_up(instant.arithmetic(F.col("query")), 4)).drop("query")


def equation_answers(spark, d):
    """A linear equation and a power for every part."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    sign = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    q = F.concat(F.lit("solve "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("x "), sign, F.lit(" "), "s", F.lit(" = "), (F.col("p_partkey") % 97).cast("string"))
    power = F.concat(F.lit("derivative of "), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit("x^"), (F.col("s") % 4 + 1).cast("string"))
    return p.select("p_partkey", instant.linear(q).alias("x"), instant.derivative(power).alias("derivative"))


def clock_answers(spark, d):
    """A time of the day for every order, in the zones that its key falls on, on the day of the order."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("day"))
    hour, minute = F.col("o_orderkey") % 24, F.col("o_orderkey") % 60
    at = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    q = F.concat_ws(" ", at, _cycle([a for a, _ in CLOCKS], F.col("o_orderkey")), F.lit("to"), _cycle([b for _, b in CLOCKS], F.col("o_orderkey")))
    return o.select("o_orderkey", q.alias("query"), "day").select("o_orderkey", "query", instant.clock(F.col("query"), F.col("day")).alias("time"))


def shortcut_answers(spark, d):
    """The search queries behind a shortcut, before and after it."""
    keys = sorted(instant.SHORTCUTS)
    q = table(spark, d, "search_queries").select("query_id", F.regexp_replace(F.coalesce("raw_query", F.lit("")), "[^A-Za-z0-9 ]", "").alias("t")).withColumn("t", F.trim(F.regexp_replace("t", " +", " "))).filter("t != ''")
    key = _cycle(keys, F.length("t"))
    return q.select("query_id", instant.shortcut(F.concat(F.lit("!"), key, F.lit(" "), "t")).alias("first"), instant.shortcut(F.concat("t", F.lit(" !"), key)).alias("last"), instant.shortcut(F.concat(F.lit("!none "), "t")).alias("unknown"))


def network_answers(spark, d):
    """Networks of addresses made of customer keys, and the services of ports."""
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    q = F.concat_ws("", (k % 223 + 1).cast("string"), F.lit("."), (k % 256).cast("string"), F.lit("."), (k * 7 % 256).cast("string"), F.lit("."), (k * 13 % 256).cast("string"), F.lit("/"), (k % 25 + 8).cast("string"))
    return c.select("c_custkey", instant.cidr(q).alias("n"), instant.port(F.concat(F.lit("port "), (k % 1000).cast("string"))).alias("service")).select("c_custkey", "n.network", "n.broadcast", "n.hosts", "service")


def cron_answers(spark, d):
    o = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    k = F.col("p_partkey")
    q = F.concat_ws(" ", F.when(k % 3 == 0, "*").when(k % 3 == 1, F.concat(F.lit("*/"), F.col("s").cast("string"))).otherwise(F.col("s").cast("string")), (k % 24).cast("string"), F.lit("*"), F.when(k % 2 == 0, "1-6").otherwise("1,7"), F.lit("*"))
    return o.select("p_partkey", instant.cron(q).alias("words"))


def codec_answers(spark, d):
    """Round trips and decoded tokens over the search queries."""
    q = table(spark, d, "search_queries").filter("raw_query is not null").select("query_id", F.col("raw_query").alias("q"))
    b64 = lambda c: F.regexp_replace(F.translate(F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_"), "=+$", "")
    payload = F.to_json(F.struct(F.length("q").alias("n"), F.col("query_id").alias("sub")))
    token = F.concat(b64(F.lit('{"alg":"none"}')), F.lit("."), b64(payload), F.lit("."), F.lit("x"))
    claims = instant.token_claims(token)
    return q.select("query_id", (F.url_decode(F.url_encode("q")) == F.col("q")).alias("url_ok"), F.get_json_object(claims["header"], "$.alg").alias("alg"), F.get_json_object(claims["payload"], "$.sub").alias("sub"),
                    F.get_json_object(claims["payload"], "$.n").cast("int").alias("n"), F.length(F.sha2("q", 512)).alias("sha512_size"))


def colour_hsl(spark, d):
    """Colours of all record ids' first six hexadecimal digits, as hue, saturation and lightness."""
    c = table(spark, d, "raw_documents").select(F.substring("id", 1, 6).alias("hex")).distinct()
    part = lambda i: F.conv(F.substring("hex", i, 2), 16, 10).cast("int")
    return c.select("hex", instant.hsl(part(1), part(3), part(5)).alias("c")).select("hex", "c.h", "c.s", "c.l")


def instant_dispatch(spark, d):
    """Which form answers each of a mixed set of queries: those of all suppliers' keys in turn, and the search queries."""
    now = F.lit("2025-07-01 12:00:00").cast("timestamp")
    k = F.col("s_suppkey")
    mixed = F.element_at(F.array(F.concat(k.cast("string"), F.lit(" km to miles")), F.concat(k.cast("string"), F.lit(" usd to eur")), F.concat(F.lit("10.0.0."), (k % 256).cast("string"), F.lit("/24")), F.concat(F.lit("!w "), k.cast("string")), F.concat(F.lit("solve 2x + 1 = "), k.cast("string")), F.lit("time in tokyo"), F.lit("port 443"), F.lit("derivative of x^3")), (k % 8 + 1).cast("int"))
    s = table(spark, d, "supplier").select(k.cast("string").alias("key"), mixed.alias("query")).unionByName(table(spark, d, "search_queries").select(F.col("query_id").alias("key"), F.col("raw_query").alias("query")))
    return s.select("key", instant.answer(F.col("query"), now).alias("a")).select("key", "a.kind")


QUERIES = {f.__name__: f for f in (unit_answers, money_answers, arithmetic_answers, equation_answers, clock_answers, shortcut_answers, network_answers, cron_answers, codec_answers, colour_hsl, instant_dispatch)}


def _pick(items, number: str) -> str:
    return f"[{', '.join(S.q(x) if isinstance(x, str) else str(x) for x in items)}][({number} % {len(items)} + 1)::INT]"


# literal expectations: metres, grams, bytes, kilometres an hour to one unit of each pair
RATIO = [1000.0 / 1609.34, 0.3048, 1000.0 / 453.592, 28.3495, 1024.0, 1024.0, 1.852 / 1.609344]
RATES = [0.92, 154.5 / 0.79, 83.4, 1.36 / 0.92, 67500.0, 20.0]

ORACLE = {
    "unit_answers": f"""WITH p AS (SELECT p_partkey, p_size::INT AS s, (p_partkey % 9)::INT AS i FROM part) SELECT p_partkey, s || ' ' || {_pick([a for a, _, _ in PAIRS], 'p_partkey')} || ' to ' || {_pick([b for _, b, _ in PAIRS], 'p_partkey')} AS query,
        CASE i WHEN 7 THEN {S.r('s * 9 / 5.0 + 32', 2)} WHEN 8 THEN {S.r('(s - 32) * 5 / 9.0', 2)} ELSE {S.r(f'CASE i {" ".join(f"WHEN {i} THEN s * {x!r}::DOUBLE" for i, x in enumerate(RATIO))} END', 4)} END AS value FROM p""",
    "money_answers": f"""WITH c AS (SELECT c_custkey, abs(c_acctbal::DECIMAL(15,2)) AS v, (c_custkey % 6)::INT AS i FROM customer) SELECT c_custkey, v || ' ' || {_pick([a for a, _ in MONEY], 'c_custkey')} || ' in ' || {_pick([b for _, b in MONEY], 'c_custkey')} AS query,
        CASE WHEN i < 4 THEN {S.r(f'v::DOUBLE * CASE i {" ".join(f"WHEN {i} THEN {x!r}::DOUBLE" for i, x in enumerate(RATES))} END', 2)} ELSE {S.r('v::DOUBLE * CASE i WHEN 4 THEN 67500.0 ELSE 20.0 END', 4)} END AS value FROM c""",
    "arithmetic_answers": f"SELECT p_partkey, {S.r('(p_retailprice::DECIMAL(15,2)::DOUBLE + p_size::INT) * 4 + p_size::INT / 4.0 + sqrt(p_size::INT) + 0.1 * p_size::INT', 4)} AS value FROM part",
    "equation_answers": f"""SELECT p_partkey, {S.r('(p_partkey % 97 - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * p_size::INT) / (p_partkey % 9 + 1)::DOUBLE', 4)} AS x,
        CASE WHEN n = 1 THEN (a * n)::VARCHAR ELSE CASE WHEN a * n <> 1 THEN (a * n)::VARCHAR ELSE '' END || 'x' || CASE WHEN n > 2 THEN '^' || (n - 1) ELSE '' END END AS derivative FROM (SELECT *, p_partkey % 5 + 1 AS a, p_size::INT % 4 + 1 AS n FROM part)""",
    "clock_answers": f"""WITH o AS (SELECT o_orderkey, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS t, (o_orderkey % 5)::INT AS i, date_trunc('day', o_orderdate::TIMESTAMP) + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) AS ts FROM orders)
        SELECT o_orderkey, t || ' ' || {_pick([a for a, _ in CLOCKS], 'o_orderkey')} || ' to ' || {_pick([b for _, b in CLOCKS], 'o_orderkey')} AS query, strftime(timezone({_pick(['Asia/Tokyo', 'Europe/London', 'Asia/Kolkata', 'UTC', 'Australia/Sydney'], 'o_orderkey')},
        timezone({_pick(['UTC', 'America/New_York', 'Asia/Tokyo', 'America/Los_Angeles', 'Europe/Paris'], 'o_orderkey')}, ts)), '%H:%M') AS "time" FROM o""",
    "shortcut_answers": f"""WITH q AS (SELECT query_id, trim(regexp_replace(regexp_replace(coalesce(raw_query, ''), '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS t FROM search_queries), u AS (SELECT query_id, replace({_pick([instant.SHORTCUTS[k] for k in sorted(instant.SHORTCUTS)], 'length(t)')}, '{{q}}', replace(t, ' ', '%20')) AS x FROM q WHERE t <> '')
        SELECT query_id, x AS "first", x AS "last", NULL::VARCHAR AS unknown FROM u""",
    "network_answers": f"""WITH c AS (SELECT c_custkey, (c_custkey % 223 + 1) * 16777216::BIGINT + (c_custkey % 256) * 65536::BIGINT + (c_custkey * 7 % 256) * 256 + c_custkey * 13 % 256 AS n, c_custkey % 25 + 8 AS bits FROM customer), z AS (SELECT *, (1::BIGINT << (32 - bits)::INT) AS size, n - n % (1::BIGINT << (32 - bits)::INT) AS low FROM c)
        SELECT c_custkey, concat_ws('.', low >> 24, (low >> 16) & 255, (low >> 8) & 255, low & 255) AS network, concat_ws('.', (low + size - 1) >> 24, ((low + size - 1) >> 16) & 255, ((low + size - 1) >> 8) & 255, (low + size - 1) & 255) AS broadcast,
        CASE bits WHEN 32 THEN 1 WHEN 31 THEN 2 ELSE size - 2 END AS hosts, CASE c_custkey % 1000 {' '.join(f"WHEN {p} THEN {S.q(n)}" for p, n in instant.PORTS.items() if p < 1000)} END AS service FROM z""",
    "cron_answers": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'every minute' WHEN 1 THEN 'every ' || p_size::INT || ' minutes' ELSE 'minute ' || p_size::INT END || '; hour ' || p_partkey % 24 || '; every day of month; ' || CASE WHEN p_partkey % 2 = 0 THEN 'months 1 to 6' ELSE 'months 1, 7' END || '; every day of week' AS words FROM part""",
    "codec_answers": "SELECT query_id, true AS url_ok, 'none' AS alg, query_id AS sub, length(raw_query) AS n, 128 AS sha512_size FROM search_queries WHERE raw_query IS NOT NULL",
    "colour_hsl": f"""WITH c AS (SELECT DISTINCT left(id, 6) AS hex FROM raw_documents), v AS (SELECT hex, ('0x' || substr(hex, 1, 2))::INT / 255.0 AS x, ('0x' || substr(hex, 3, 2))::INT / 255.0 AS y, ('0x' || substr(hex, 5, 2))::INT / 255.0 AS z FROM c), w AS (SELECT *, greatest(x, y, z)::DOUBLE AS hi, least(x, y, z)::DOUBLE AS lo FROM v)
        SELECT hex, {S.r('CASE WHEN hi = lo THEN 0 WHEN hi = x THEN (y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END WHEN hi = y THEN (z - x) / (hi - lo) + 2 ELSE (x - y) / (hi - lo) + 4 END / 6 * 360', 0)}::INT AS h,
        {S.r('100 * CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END', 0)}::INT AS s, {S.r('(hi + lo) / 2 * 100', 0)}::INT AS l FROM w""",
    "instant_dispatch": "SELECT s_suppkey::VARCHAR AS key, ['unit', 'money', 'network', 'shortcut', 'linear', 'clock', 'port', 'derivative'][(s_suppkey % 8 + 1)::INT] AS kind FROM supplier UNION ALL SELECT query_id, NULL FROM search_queries",
}
