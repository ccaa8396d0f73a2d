"""Registered queries: every operator over the star-schema tables, each with the same result as DuckDB SQL where SQL has one.

The tables hold no statements, so each query derives its lines, receipts, logs or texts from them first; the derivation is
written twice, in Spark and in SQL, and the operator once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.dates import any_date, date_order, order_vote, resolve_date
from ledgerloom.functions.money import decimal_vote, document_mark, format_cents, normalise_currency, parse_cents
from ledgerloom.functions.names import containment, normalise_merchant, stable_name, with_similarity
from ledgerloom.operators import decisions, extract, integrity, pairing, queue, selfaudit, verdict
from ledgerloom.scratch import scratch_path, written
from ledgerloom.sources import documents, sinks
from ledgerloom.sources.statements import parse_csv, parse_ofx, statement_rows, statements_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents_of(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


# Money, dates and names.

_PRICES = "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem"


@query(
    f"SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 2 THEN -c WHEN 4 THEN -c WHEN 5 THEN c // 100 * 100 ELSE c END AS cents FROM ({_PRICES})"
)
def parse_money(spark, sf_dir):
    c = cents_of("l_extendedprice")
    plain, kind = format_cents(c), F.col("l_orderkey") % 6
    raw = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("€ "), F.translate(plain, ".", ",")))
        .when(kind == 2, F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == 3, F.concat(F.format_number((c / 100).cast("bigint"), 0), F.substring(plain, -3, 3), F.lit(" CR")))
        .when(kind == 4, F.concat(plain, F.lit(" DR")))
        .otherwise(F.substring_index(plain, ".", 1))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return lines.select("l_orderkey", "l_linenumber", parse_cents(F.col("raw"), F.when(F.col("l_orderkey") % 6 == 1, F.lit(",")).otherwise(F.lit("."))).alias("cents"))


@query("SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN '.' WHEN l_suppkey % 3 = 1 THEN ',' WHEN count(DISTINCT l_orderkey % 2) > 1 THEN '' WHEN min(l_orderkey % 2) = 0 THEN '.' ELSE ',' END AS mark FROM lineitem GROUP BY l_suppkey")
def decimal_evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    plain = format_cents(cents_of("l_extendedprice"))
    comma = (F.col("l_suppkey") % 3 == 1) | ((F.col("l_suppkey") % 3 == 2) & (F.col("l_orderkey") % 2 == 1))
    raw = F.when(comma, F.translate(plain, ".", ",")).otherwise(plain)
    votes = lines.select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("at"), decimal_vote(raw).alias("vote"))
    return votes.groupBy("l_suppkey").agg(document_mark(F.col("vote"), F.col("at")).alias("mark"))


@query("""
SELECT o_orderkey, CASE WHEN kind = 0 OR (seen AND kind < 3) THEN CAST(o_orderdate AS DATE)
  WHEN dmy AND NOT mdy THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END
  WHEN mdy AND NOT dmy THEN CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END END AS date,
CASE WHEN kind = 0 THEN '' WHEN NOT seen THEN 'unsettled' WHEN kind = 1 THEN 'dmy' WHEN kind = 2 THEN 'mdy' WHEN dmy AND mdy THEN 'mixed' WHEN dmy THEN 'dmy' ELSE 'mdy' END AS date_order
FROM (SELECT *, o_custkey % 4 AS kind, bool_or(day(o_orderdate) > 12) OVER w AS seen, bool_or(day(o_orderdate) > 12 AND o_orderkey % 2 = 0) OVER w AS dmy, bool_or(day(o_orderdate) > 12 AND o_orderkey % 2 = 1) OVER w AS mdy
  FROM orders WINDOW w AS (PARTITION BY o_custkey))
""")
def statement_dates(spark, sf_dir):
    """ISO, day first, month first, and files in which both occur; files whose order can't be told have no dates."""
    kind = F.col("o_custkey") % 4
    day_first, iso = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    month_first = F.date_format("o_orderdate", "MM/dd/yyyy")
    raw = F.when(kind == 0, iso).when((kind == 1) | ((kind == 3) & (F.col("o_orderkey") % 2 == 0)), day_first).otherwise(month_first)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", raw.alias("raw"), kind.alias("kind"))
    orders = rows.groupBy("o_custkey").agg(date_order(order_vote(F.col("raw"))).alias("date_order"))
    known = F.when(~F.col("date_order").isin("mixed", "unsettled"), resolve_date(F.col("raw"), F.col("date_order")))
    return rows.join(orders, "o_custkey").select("o_orderkey", known.alias("date"), "date_order")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 2 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) WHEN o_orderkey % 8 < 7 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""")
def any_dates(spark, sf_dir):
    """The fixed formats one after another; of the two that can be taken for each other, the day comes first."""
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/M/d", "d-M-yyyy", "dd.MM.yyyy", "yyyyMMdd")
    raw = F.lit("31/02/2024")
    for k, f in enumerate(formats):
        raw = F.when(F.col("o_orderkey") % 8 == k, F.concat(F.lit(" "), F.date_format("o_orderdate", f), F.lit(" " if k == 6 else ""))).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", any_date(raw).alias("date"))


_MERCHANT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\bsq \*|\btst\*|\bsp \*|\bpp\*|\bpaypal \*', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'),
'\b(?:pos|purchase|debit|credit|card|visa|mastercard|amex|payment|pmt|transaction|txn|ref|auth|recurring|online|www|com|inc|llc|ltd|co|store|shop|no|nr|id|xx+|[0-9]{4,})\b', ' ', 'g'), ' +', ' ', 'g'))"""
_PART_RAW = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SQ *' WHEN 1 THEN 'POS Purchase ' ELSE '' END || p_name || ' #' || (p_partkey * 37) || ' ' || p_brand || ' Inc.' AS raw FROM part"


@query(f"SELECT p_partkey, m AS merchant, CASE WHEN regexp_matches(m, '^[^ ]+( [^ ]*[0-9][^ ]*)+$') THEN regexp_extract(m, '^[^ ]+') ELSE regexp_replace(m, '( [^ ]*[0-9][^ ]*)+$', '') END AS stable FROM (SELECT p_partkey, {_MERCHANT} AS m FROM ({_PART_RAW}))")
def merchant_names(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 3 == 0, F.lit("SQ *")).when(F.col("p_partkey") % 3 == 1, F.lit("POS Purchase ")).otherwise(F.lit(""))
    raw = F.concat(head, F.col("p_name"), F.lit(" #"), (F.col("p_partkey") * 37).cast("string"), F.lit(" "), F.col("p_brand"), F.lit(" Inc."))
    names = table(spark, sf_dir, "part").select("p_partkey", normalise_merchant(raw).alias("merchant"))
    return names.withColumn("stable", stable_name(F.col("merchant")))


_NAME_PAIRS = f"""
WITH n AS (SELECT p_partkey, p_size, {_MERCHANT.replace("lower(raw)", "lower(p_name)")} AS a FROM part),
q AS (SELECT p_partkey, lead(p_partkey) OVER w AS other, a, lead(a) OVER w AS b FROM n WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey))
"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name beside the next one's of its size."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", normalise_merchant(F.col("p_name")).alias("a"))
    next_ = Window.partitionBy("p_size").orderBy("p_partkey")
    return part.withColumns({"other": F.lead("p_partkey").over(next_), "b": F.lead("a").over(next_)}).filter(F.col("other").isNotNull())


@query(_NAME_PAIRS + """SELECT p_partkey, other, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))
/ least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))) END AS shared FROM q WHERE other IS NOT NULL""")
def name_containment(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("p_partkey", "other", containment(F.col("a"), F.col("b")).alias("shared"))


def _similar_sql(pairs: str) -> str:
    """SQL for the similarity of (p_partkey, a, b): matching blocks by recursion. The longest run of equal letters, the earliest on ties, parts
    both names in two, and so on; ``r`` holds the run that begins at each pair of equal letters."""
    shared = "len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' '))))"
    return f"""
WITH RECURSIVE {pairs},
h AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE {shared} END AS held FROM p),
o AS (SELECT * FROM h WHERE held < 1 AND a <> '' AND b <> ''),
e AS (SELECT p_partkey, i, j FROM (SELECT p_partkey, a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM o)) WHERE a[i] = b[j]),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, i - j ORDER BY i) AS island FROM e),
r AS (SELECT p_partkey, i, j, max(i) OVER (PARTITION BY p_partkey, i - j, island) - i + 1 AS run FROM g),
seg AS (SELECT p_partkey, CAST(1 AS BIGINT) AS alo, CAST(length(a) + 1 AS BIGINT) AS ahi, CAST(1 AS BIGINT) AS blo, CAST(length(b) + 1 AS BIGINT) AS bhi, CAST(0 AS BIGINT) AS size FROM o
  UNION ALL
  SELECT p_partkey, CASE WHEN side = 0 THEN alo ELSE i + k END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + k END, CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN k ELSE 0 END
  FROM (SELECT seg.*, i, j, least(run, ahi - i, bhi - j) AS k FROM seg JOIN r ON r.p_partkey = seg.p_partkey AND i >= alo AND i < ahi AND j >= blo AND j < bhi
    QUALIFY row_number() OVER (PARTITION BY seg.p_partkey, alo, ahi, blo, bhi ORDER BY least(run, ahi - i, bhi - j) DESC, i, j) = 1) AS x, (VALUES (0), (1)) AS v(side)),
m AS (SELECT p_partkey, 2.0::DOUBLE * sum(size) / (any_value(length(a)) + any_value(length(b))) AS ratio FROM seg JOIN o USING (p_partkey) GROUP BY p_partkey)
SELECT h.*, round_even(greatest(held, CASE WHEN ratio >= 0.8 THEN ratio ELSE 0 END)::DOUBLE, 3) AS similarity FROM h LEFT JOIN m USING (p_partkey)"""


@query(f"SELECT p_partkey, other, similarity FROM ({_similar_sql(_NAME_PAIRS.replace('WITH', '').strip() + ', p AS (SELECT * FROM q WHERE other IS NOT NULL)')})")
def name_similarity(spark, sf_dir):
    return with_similarity(name_pairs(spark, sf_dir), "a", "b", "similarity").select("p_partkey", "other", F.bround("similarity", 3).alias("similarity"))


_MISSPELT = "regexp_replace({0}, '[aeiou]', 'u')", "{0}[1:4] || {0}[6:]", "reverse({0}[1:3]) || {0}[4:]", "{0}[5:] || {0}[1:4]", "{0} || {0}[3:5]"


@query("SELECT p_partkey, b AS spelt, similarity FROM (" + _similar_sql(f"""p AS (SELECT *, trim(regexp_replace(CASE p_partkey % 5 {" ".join(f"WHEN {k} THEN {x.format('a')}" for k, x in enumerate(_MISSPELT))} END, ' +', ' ', 'g')) AS b
  FROM (SELECT p_partkey, replace({_MERCHANT.replace("lower(raw)", "lower(p_name)")}, ' ', '') || p_partkey % 7 AS a FROM part))""") + ")")
def misspelt_names(spark, sf_dir):
    """One-word names beside themselves with a letter changed, lost, moved or added, where letters alone decide."""
    a, k = F.col("a"), F.col("p_partkey") % 5
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace(normalise_merchant(F.col("p_name")), F.lit(" "), F.lit("")), (F.col("p_partkey") % 7).cast("string")).alias("a"))
    cut = lambda at, n=None: F.substring(a, at, n or 1000)
    b = (
        F.when(k == 0, F.concat(F.regexp_extract(a, "^([^aeiou]*)", 1), F.when(a.rlike("[aeiou]"), F.lit("u")).otherwise(F.lit("")), F.regexp_extract(a, "^[^aeiou]*[aeiou](.*)$", 1)))
        .when(k == 1, F.concat(cut(1, 4), cut(6)))
        .when(k == 2, F.concat(F.reverse(cut(1, 3)), cut(4)))
        .when(k == 3, F.concat(cut(5), cut(1, 4)))
        .otherwise(F.concat(a, cut(3, 3)))
    )
    return with_similarity(names.withColumn("b", b), "a", "b", "similarity").select("p_partkey", F.col("b").alias("spelt"), F.bround("similarity", 3).alias("similarity"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN upper(substr(n_name, 1, 3)) ELSE NULL END AS currency FROM nation")
def currencies(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    mark = F.when(k == 0, F.lit("€")).when(k == 1, F.lit(" usd ")).when(k == 2, F.substring("n_name", 1, 3)).otherwise(F.lit("12%"))
    return table(spark, sf_dir, "nation").select("n_nationkey", normalise_currency(mark).alias("currency"))


# Statement integrity: orders of a customer as lines, balances by running sum, some lines dropped or altered.

_WALK = """
WITH b AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date, -CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
  row_number() OVER w AS row, 100000000 + sum(-CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS balance FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (SELECT *, lag(balance) OVER (PARTITION BY o_custkey ORDER BY row) + amount AS expected FROM b WHERE NOT (o_custkey % 5 = 0 AND row = 3)),
w AS (SELECT o_custkey, count(*) AS n, min(CASE WHEN expected <> balance THEN row END) AS break_row, sum(amount) AS s FROM l GROUP BY o_custkey),
f AS (SELECT o_custkey, sum(amount) AS declared FROM b GROUP BY o_custkey),
c AS (SELECT w.o_custkey, CASE WHEN n >= 2 AND w.o_custkey % 11 <> 4 THEN break_row IS NULL END AS walk_ok, CASE WHEN n >= 2 AND w.o_custkey % 11 <> 4 THEN break_row END AS break_row,
  CASE WHEN w.o_custkey % 2 = 0 THEN s = declared END AS total_ok FROM w JOIN f USING (o_custkey))
"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"), (-cents_of("o_totalprice")).alias("amount_cents"), "o_orderdate")
    rows = rows.withColumns({"row": F.row_number().over(w), "balance_cents": F.sum("amount_cents").over(w) + 100_000_000})
    return rows.withColumn("statement_id", F.col("o_custkey"))


def order_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = order_lines(spark, sf_dir)
    declared = lines.groupBy("statement_id").agg(F.sum("amount_cents").alias("all")).select("statement_id", F.when(F.col("statement_id") % 2 == 0, F.col("all")).alias("period_total_cents"), F.lit(None).cast("bigint").alias("opening_balance_cents"), F.lit(None).cast("bigint").alias("closing_balance_cents"))
    # Some exports run backwards, so their balances can't be walked.
    lines = lines.withColumn("date", F.when(F.col("o_custkey") % 11 == 4, F.date_sub("date", F.col("row") * 4000)).otherwise(F.col("date")))
    return lines.filter(~((F.col("o_custkey") % 5 == 0) & (F.col("row") == 3))), declared


@query(_WALK + "SELECT o_custkey AS statement_id, walk_ok, break_row FROM c")
def balance_walk(spark, sf_dir):
    return integrity.balance_walk(order_statements(spark, sf_dir)[0]).select("statement_id", "walk_ok", "break_row")


@query(
    _WALK
    + """SELECT o_custkey AS statement_id, walk_ok, break_row, total_ok,
CASE WHEN walk_ok = false OR total_ok = false THEN 'incomplete' WHEN walk_ok OR total_ok THEN 'whole' ELSE 'unverifiable' END AS state,
NOT (coalesce(walk_ok = false, false) OR coalesce(total_ok = false, false)) AS usable,
NOT (coalesce(walk_ok = false, false) OR coalesce(total_ok = false, false)) AND (coalesce(walk_ok, false) OR coalesce(total_ok, false)) AS verified FROM c"""
)
def completeness_states(spark, sf_dir):
    return integrity.completeness(*order_statements(spark, sf_dir))


@query(_WALK + "SELECT o_custkey AS statement_id, total_ok AS ok FROM c")
def statement_sums(spark, sf_dir):
    return integrity.statement_sum(*order_statements(spark, sf_dir))


# Self-audit: events of a user as charges at three merchants under two names each, some undated; clicks as credits.

MERCHANTS = (
    "Harbour Freight", "Alpine Dairy", "Meridian Telecom", "Copper Kettle", "Willow Bakery", "Falcon Insurance", "Juniper Gym",
    "Saffron Kitchen", "Orchard Water", "Granite Rentals", "Velvet Cinema", "Thistle Garage", "Beacon Energy", "Lantern Books",
)
_LIST = "[" + ", ".join(f"'{m}'" for m in MERCHANTS) + "]"


def _described(which: str, branch: str) -> tuple[str, str]:
    """SQL for the description of a line of merchant ``which`` and its normal name; ``branch`` is 0 or 1."""
    base = f"({_LIST})[{which} + 1]"
    return f"CASE WHEN {branch} = 0 THEN 'SQ *' || {base} || ' 0042' ELSE {base} || ' Lisbon' END", f"lower({base}) || CASE WHEN {branch} = 0 THEN '' ELSE ' lisbon' END"


def described(which, branch):
    base = F.element_at(F.array(*map(F.lit, MERCHANTS)), (which + 1).cast("int"))
    return F.when(branch == 0, F.concat(F.lit("SQ *"), base, F.lit(" 0042"))).otherwise(F.concat(base, F.lit(" Lisbon")))


_EVENT_TEXT, _EVENT_NAME = _described("event_id % 3", "event_id // 3 % 2")
_EVENT_LINES = f"""
WITH l AS (SELECT user_id AS statement_id, event_id AS row, CASE WHEN event_id % 50 <> 7 THEN CAST(ts AS DATE) END AS date, event_id % 3 AS m, {_EVENT_TEXT} AS description, {_EVENT_NAME} AS name,
  CAST(round(value) AS BIGINT) * 100 * CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS amount FROM events),
b AS (SELECT *, -amount AS cents, first_value(name) OVER (PARTITION BY statement_id, amount, m ORDER BY row) AS leader, lag(row) OVER w AS before, lag(description) OVER w AS before_name,
  CASE WHEN date IS NOT NULL THEN datediff('day', lag(date) OVER w, date) END AS gap FROM l WHERE amount < 0 WINDOW w AS (PARTITION BY statement_id, amount, m ORDER BY date NULLS LAST, row)),
k AS (SELECT *, coalesce(bool_and(gap BETWEEN 26 AND 35) OVER (PARTITION BY statement_id, cents, m), false) AS monthly FROM b),
p AS (SELECT statement_id, cents, leader, before_name AS merchant, gap AS days_apart, before AS first_row, row AS second_row, date FROM k WHERE gap <= 3 AND NOT monthly),
f AS (SELECT statement_id, cents, merchant, days_apart, first_row, second_row,
  (SELECT min(l.row) FROM l WHERE l.statement_id = p.statement_id AND l.amount = p.cents AND l.name = p.leader AND (l.date IS NULL OR l.date >= p.date)) AS refund_row FROM p
  UNION ALL SELECT statement_id, cents, arg_min(description, row), NULL, min(row), max(row), NULL FROM k GROUP BY statement_id, cents, m, monthly HAVING count(*) > 1 AND NOT monthly AND count(date) < count(*)),
t AS (SELECT *, CASE WHEN refund_row IS NULL AND days_apart IS NOT NULL THEN cents ELSE 0 END AS at_risk FROM f)
"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "click", F.lit(1)).otherwise(F.lit(-1))
    k = F.col("event_id")
    date = F.when(k % 50 != 7, F.to_date("ts"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("statement_id"), k.alias("row"), date.alias("date"), described(k % 3, F.floor(k / 3) % 2).alias("description"), (F.round("value").cast("bigint") * 100 * sign).alias("amount_cents"))


@query(_EVENT_LINES + "SELECT statement_id, cents, merchant, days_apart, first_row, second_row, refund_row, at_risk, row_number() OVER (PARTITION BY statement_id ORDER BY cents DESC, first_row, second_row, days_apart NULLS LAST) AS rank FROM t")
def paid_twice(spark, sf_dir):
    return selfaudit.paid_twice(event_lines(spark, sf_dir)).select("statement_id", "cents", "merchant", F.col("days_apart").cast("bigint").alias("days_apart"), "first_row", "second_row", "refund_row", F.col("at_risk").cast("bigint").alias("at_risk"), F.col("rank").cast("bigint").alias("rank"))


@query(_EVENT_LINES + "SELECT statement_id, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM t GROUP BY statement_id")
def double_risk(spark, sf_dir):
    return selfaudit.double_risk(selfaudit.suspects(event_lines(spark, sf_dir)))


_FACTS = """
g AS (SELECT *, datediff('day', lag(date) OVER w, date) AS gap FROM d WINDOW w AS (PARTITION BY statement_id, m ORDER BY date, row)),
a AS (SELECT statement_id, m, count(*) AS charges, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, min(date) AS first_seen, max(date) AS last_seen, arg_min(cents, (date, row)) AS first_cents, arg_max(cents, (date, row)) AS last_cents,
  arg_min(name, row) AS leader, arg_max(description, (date, row)) AS merchant, min(row) AS r1, max(row) AS r2 FROM g GROUP BY statement_id, m),
r AS (SELECT *, last_cents - first_cents AS rise FROM a WHERE charges >= 3 AND gaps[len(gaps) // 2 + 1] BETWEEN 26 AND 35),
o AS (SELECT statement_id, min(date) AS opened FROM l GROUP BY statement_id)
"""
_SHIP_TEXT, _SHIP_NAME = _described("m", "l_orderkey % 2")
_RUNS = f"""
WITH l AS (SELECT l_suppkey AS statement_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS row, CAST(l_shipdate AS DATE) AS date, m, {_SHIP_TEXT} AS description, {_SHIP_NAME} AS name, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM (SELECT *, (l_linenumber - 1) * 2 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS m FROM lineitem)),
d AS (SELECT * FROM l), {_FACTS}
"""


def ship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's shipments as charges at fourteen merchants, each under two names."""
    which = (F.col("l_linenumber") - 1) * 2 + F.when(F.col("l_linestatus") == "F", F.lit(1)).otherwise(F.lit(0))
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("statement_id"), row.alias("row"), F.to_date("l_shipdate").alias("date"), described(which, F.col("l_orderkey") % 2).alias("description"), (-cents_of("l_extendedprice")).alias("amount_cents"))


@query(_RUNS + "SELECT statement_id, leader, merchant, charges, last_cents AS latest_cents, last_cents * 12 AS a_year_cents, first_seen, last_seen, row_number() OVER (PARTITION BY statement_id ORDER BY last_cents DESC, r1) AS rank FROM r")
def recurring_runs(spark, sf_dir):
    return selfaudit.recurring(selfaudit.runs(ship_lines(spark, sf_dir))).select("statement_id", "leader", "merchant", "charges", "latest_cents", "a_year_cents", "first_seen", "last_seen", F.col("rank").cast("bigint").alias("rank"))


@query(_RUNS + "SELECT r.statement_id, r.leader, r.first_cents, r.last_cents, rise AS rise_cents, rise * 12 AS at_risk, min(l.date) AS rose_on FROM r JOIN l ON l.statement_id = r.statement_id AND l.m = r.m AND l.cents > r.first_cents + 50 WHERE rise > 50 GROUP BY ALL")
def price_rises(spark, sf_dir):
    return selfaudit.price_rises(selfaudit.runs(ship_lines(spark, sf_dir))).select("statement_id", "leader", "first_cents", "last_cents", "rise_cents", "at_risk", "rose_on")


@query(_RUNS + "SELECT statement_id, leader, charges, last_cents, last_cents * 12 AS at_risk, first_seen FROM r JOIN o USING (statement_id) WHERE first_seen > opened + 45")
def new_recurring(spark, sf_dir):
    lines = ship_lines(spark, sf_dir)
    return selfaudit.new_recurring(selfaudit.runs(lines), lines).select("statement_id", "leader", "charges", "last_cents", "at_risk", "first_seen")


@query(_RUNS + "SELECT DISTINCT statement_id, name, first_value(name) OVER (PARTITION BY statement_id, m ORDER BY row) AS leader FROM l")
def merchant_clusters(spark, sf_dir):
    names = selfaudit.billed(ship_lines(spark, sf_dir)).select("statement_id", stable_name(F.col("merchant")).alias("name"), "row")
    return selfaudit.leaders(names, ["statement_id"], selfaudit.SAME_RUN)


@query(_EVENT_LINES + f""", d AS (SELECT statement_id, row, date, m, name, description, cents FROM b WHERE date IS NOT NULL), {_FACTS},
u AS (SELECT statement_id, 'paid_twice' AS kind, 0 AS place, merchant, at_risk, first_row AS r1, second_row AS r2, days_apart FROM t
  UNION ALL SELECT statement_id, 'price_rose', 1, merchant, rise * 12, r1, r2, NULL FROM r WHERE rise > 50
  UNION ALL SELECT statement_id, 'new_recurring', 2, merchant, last_cents * 12, r1, r2, NULL FROM r JOIN o USING (statement_id) WHERE first_seen > opened + 45)
SELECT statement_id, kind, merchant, at_risk, row_number() OVER (PARTITION BY statement_id ORDER BY at_risk DESC, place, r1, r2, days_apart NULLS LAST) AS rank FROM u""")
def audit_findings(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("balance_cents", F.lit(None).cast("bigint"))
    nothing = F.lit(None).cast("bigint")
    statements = lines.select("statement_id").distinct().select("statement_id", nothing.alias("period_total_cents"), nothing.alias("opening_balance_cents"), nothing.alias("closing_balance_cents"))
    found = selfaudit.audit(lines, integrity.completeness(lines, statements))
    return found.select("statement_id", "kind", "merchant", F.col("at_risk").cast("bigint").alias("at_risk"), F.col("rank").cast("bigint").alias("rank"))


@query(_EVENT_LINES + f""", d AS (SELECT statement_id, row, date, m, name, description, cents FROM b WHERE date IS NOT NULL), {_FACTS},
u AS (SELECT statement_id, 0 AS place, CAST(NULL AS BIGINT) AS m, cents, days_apart, at_risk, first_row AS r1, second_row AS r2 FROM t
  UNION ALL SELECT statement_id, 1, m, NULL, NULL, rise * 12, r1, r2 FROM r WHERE rise > 50
  UNION ALL SELECT statement_id, 2, m, NULL, NULL, last_cents * 12, r1, r2 FROM r JOIN o USING (statement_id) WHERE first_seen > opened + 45),
v AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY at_risk DESC, place, r1, r2, days_apart NULLS LAST) AS rank FROM u)
SELECT statement_id, rank, unnest([r1, r2]) AS row FROM v WHERE place = 0 AND days_apart IS NOT NULL
UNION ALL SELECT v.statement_id, rank, b.row FROM v JOIN b ON v.place = 0 AND v.days_apart IS NULL AND b.statement_id = v.statement_id AND b.cents = v.cents AND b.m = v.r1 % 3
UNION ALL SELECT v.statement_id, rank, d.row FROM v JOIN d ON v.place > 0 AND d.statement_id = v.statement_id AND d.m = v.m""")
def finding_rows(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("balance_cents", F.lit(None).cast("bigint"))
    nothing = F.lit(None).cast("bigint")
    statements = lines.select("statement_id").distinct().select("statement_id", nothing.alias("period_total_cents"), nothing.alias("opening_balance_cents"), nothing.alias("closing_balance_cents"))
    found = selfaudit.finding_rows(selfaudit.audit(lines, integrity.completeness(lines, statements)), lines)
    return found.select("statement_id", F.col("rank").cast("bigint").alias("rank"), "row")


# Pairing: purchases as charges, clicks as receipts, in whole units.

_PAIRS = """
WITH c AS (SELECT user_id % 10 AS statement_id, event_id AS row, CAST(ts AS DATE) AS date, CAST(round(value) AS BIGINT) * 100 AS cents FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS receipt_id, CAST(ts AS DATE) AS date, CAST(round(value) AS BIGINT) * 100 AS cents, event_id % 3 AS kind FROM events WHERE event_type = 'click'),
k AS (SELECT statement_id, row, receipt_id, CASE WHEN kind = 0 THEN 1.0 ELSE 0.0 END AS similarity, kind <> 1 AS comparable, abs(datediff('day', c.date, r.date)) AS days_apart FROM c JOIN r USING (cents) WHERE abs(datediff('day', c.date, r.date)) <= 5),
s AS (SELECT *, round(similarity - 0.01 * days_apart, 4) AS score FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY statement_id, row ORDER BY score DESC, days_apart, receipt_id) AS place, count(*) OVER (PARTITION BY statement_id, row) AS n_candidates,
  sum(CASE WHEN score >= best - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY statement_id, row) AS n_level FROM (SELECT *, max(score) OVER (PARTITION BY statement_id, row) AS best FROM s)),
o AS (SELECT *, CASE WHEN similarity < 0.45 AND comparable THEN 'unnamed' WHEN n_level > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM q WHERE place = 1)
"""


def charges_and_receipts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    cents = F.round("value").cast("bigint") * 100
    charges = events.filter("event_type = 'purchase'").select((F.col("user_id") % 10).alias("statement_id"), F.col("event_id").alias("row"), F.to_date("ts").alias("date"), F.lit("SQ *Corner Cafe 0042").alias("description"), (-cents).alias("amount_cents"))
    name = F.when(F.col("event_id") % 3 == 0, F.lit("corner cafe")).when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.lit("Harbour Hotel"))
    receipts = events.filter("event_type = 'click'").select(F.col("event_id").alias("receipt_id"), F.to_date("ts").alias("date"), name.alias("merchant"), cents.alias("total_cents"))
    return charges, receipts


@query(_PAIRS + "SELECT statement_id, row, receipt_id, CAST(similarity AS DOUBLE) AS similarity, comparable, days_apart, CAST(score AS DOUBLE) AS score FROM s")
def pairing_candidates(spark, sf_dir):
    return pairing.candidates(*charges_and_receipts(spark, sf_dir)).withColumn("days_apart", F.col("days_apart").cast("bigint")).drop("pool")


@query(_PAIRS + "SELECT statement_id, row, outcome, CASE WHEN outcome = 'matched' THEN receipt_id END AS receipt_id, n_candidates FROM o")
def pairing_resolve(spark, sf_dir):
    found = pairing.outcomes(*charges_and_receipts(spark, sf_dir))
    return found.select("statement_id", "row", "outcome", "receipt_id", "n_candidates")


@query(_PAIRS + "SELECT statement_id, row, receipt_id FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, statement_id, row) AS turn FROM o WHERE outcome = 'matched') WHERE turn = 1")
def pairing_award(spark, sf_dir):
    found = pairing.outcomes(*charges_and_receipts(spark, sf_dir))
    return pairing.award(found).select("statement_id", "row", "receipt_id")


_ROUNDS = _PAIRS.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """,
st AS (SELECT 0 AS n, statement_id, row, receipt_id, score, days_apart, similarity, comparable, false AS won, false AS closed FROM s
  UNION ALL
  SELECT n + 1, statement_id, row, receipt_id, score, days_apart, similarity, comparable, won OR win, closed OR bool_or(win) OVER (PARTITION BY receipt_id) OR bool_or(win) OVER (PARTITION BY statement_id, row)
  FROM (SELECT *, named AND row_number() OVER (PARTITION BY receipt_id, named ORDER BY score DESC, statement_id, row) = 1 AS win
    FROM (SELECT *, NOT closed AND place = 1 AND n_level = 1 AND NOT (similarity < 0.45 AND comparable) AS named
      FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, row, closed ORDER BY score DESC, days_apart, receipt_id) AS place, sum(CASE WHEN NOT closed AND score >= best - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY statement_id, row) AS n_level
        FROM (SELECT *, max(CASE WHEN NOT closed THEN score END) OVER (PARTITION BY statement_id, row) AS best FROM st))))
  QUALIFY bool_or(win) OVER ()),
z AS (SELECT * FROM st WHERE n = (SELECT max(n) FROM st)),
y AS (SELECT statement_id, row, 'matched' AS outcome, receipt_id FROM z WHERE won
  UNION ALL SELECT statement_id, row, CASE WHEN arg_max(similarity, (score, -days_apart, -receipt_id)) < 0.45 AND arg_max(comparable, (score, -days_apart, -receipt_id)) THEN 'unnamed' ELSE 'ambiguous' END, NULL
    FROM z WHERE NOT closed GROUP BY statement_id, row)
"""


@query(_ROUNDS + "SELECT c.statement_id, c.row, coalesce(outcome, 'none') AS outcome, receipt_id FROM c LEFT JOIN y ON c.statement_id = y.statement_id AND c.row = y.row")
def pairing_assign(spark, sf_dir):
    return pairing.assigned(*charges_and_receipts(spark, sf_dir)).select("statement_id", "row", "outcome", "receipt_id")


# Verdicts: an order as a receipt of its lines; figures are perturbed by key so that every answer occurs.

_RECEIPTS = """
WITH i AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS items, count(*) AS n FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, o_custkey, o_orderdate, items, n, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE items + CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 0 END END AS subtotal,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN items * 3 ELSE items // 10 END AS tax FROM orders JOIN i ON o_orderkey = l_orderkey),
t AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE coalesce(subtotal, items) + coalesce(tax, 0) END AS total FROM r),
x AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE -coalesce(total, 500) END AS amount, o_orderkey % 19 = 0 AS foreign_, o_orderkey % 3 = 0 AS generated FROM t),
k AS (SELECT *, abs(items - subtotal) <= n AS c1, subtotal + coalesce(tax, 0) = total AS c2, CASE WHEN total <> 0 AND tax IS NOT NULL THEN NOT tax > total END AS c3, CASE WHEN NOT foreign_ THEN total = abs(amount) END AS c4 FROM x),
v AS (SELECT *, CASE WHEN c1 = false OR c2 = false OR c3 = false OR c4 = false THEN 'does_not_reconcile'
  WHEN (coalesce(c1, false) OR coalesce(c2, false) OR coalesce(c3, false) OR coalesce(c4, false)) AND (NOT generated OR coalesce(c4, false)) THEN 'reconciled' ELSE 'unchecked' END AS verdict FROM k),
s AS (SELECT *, CASE WHEN verdict = 'does_not_reconcile' THEN 'failed' WHEN o_orderkey % 9 = 0 THEN 'ambiguous' WHEN verdict = 'reconciled' THEN 'filed' ELSE 'unverified' END AS state FROM v)
"""


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(cents_of("l_extendedprice").alias("amount_cents"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.sum(cents_of("l_extendedprice")).alias("sum"))
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").join(items, k == F.col("l_orderkey"))
    df = df.withColumn("subtotal_cents", F.when(k % 7 != 0, F.col("sum") + F.when(k % 11 == 0, F.lit(100)).otherwise(F.lit(0))))
    df = df.withColumn("tax_cents", F.when(k % 4 == 0, F.lit(None)).when(k % 13 == 0, F.col("sum") * 3).otherwise(F.expr("sum div 10")).cast("bigint"))
    df = df.withColumn("total_cents", F.when(k % 5 != 0, F.coalesce("subtotal_cents", "sum") + F.coalesce("tax_cents", F.lit(0))))
    nothing = F.lit(None).cast("bigint")
    df = df.withColumns({"amount_cents": F.when(k % 17 == 0, F.lit(-1)).otherwise(-F.coalesce("total_cents", F.lit(500))).cast("bigint"), "tip_cents": nothing, "fees_cents": nothing, "discount_cents": nothing})
    df = df.withColumns({"generated": k % 3 == 0, "currency": F.lit("$"), "charge_currency": F.when(k % 19 == 0, F.lit("EUR")).otherwise(F.lit("USD"))})
    rivals = F.array(k, k + 1)
    df = df.withColumns({"statement_id": F.col("o_custkey"), "row": k, "date": F.to_date("o_orderdate"), "description": F.concat(F.lit("=Order, "), k.cast("string")), "receipt_source": F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))), "merchant": F.lit("Shop"), "rivals": rivals})
    return df.withColumn("outcome", F.when(k % 9 == 0, F.lit("ambiguous")).otherwise(F.lit("matched")))


def order_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.items(verdict.reconcile(order_pairs(spark, sf_dir)))


@query(_RECEIPTS + "SELECT o_orderkey, c1, c2, c3, c4, verdict FROM v")
def receipt_checks(spark, sf_dir):
    made = verdict.reconcile(order_pairs(spark, sf_dir))
    return made.select("o_orderkey", *(F.element_at("checks", i)["ok"].alias(f"c{i}") for i in range(1, 5)), "verdict")


@query(_RECEIPTS + """, d AS (SELECT *, CASE WHEN o_orderkey % 23 = 0 THEN 'possible duplicate' ELSE state END AS st FROM s),
e AS (SELECT *, CASE st WHEN 'possible duplicate' THEN 0 WHEN 'failed' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'unverified' THEN 3 ELSE 4 END AS state_rank FROM d)
SELECT o_orderkey, st AS state, state_rank, amount AS at_risk, CASE WHEN st <> 'filed' THEN row_number() OVER (PARTITION BY o_custkey, st <> 'filed' ORDER BY state_rank, abs(amount) DESC, o_orderkey) END AS place FROM e""")
def review_queue(spark, sf_dir):
    made = order_queue(spark, sf_dir)
    marks = made.filter(F.col("row") % 23 == 0).select("statement_id", F.lit(100).cast("bigint").alias("cents"), F.lit(1).alias("days_apart"), F.lit(1).cast("bigint").alias("first_row"), F.col("row").alias("second_row"), F.lit(None).cast("bigint").alias("refund_row"))
    made = made.withColumn("seen", F.col("seen").withField("duplicate_of", F.lit(None).cast("bigint")))
    done = queue.ranked(queue.mark_duplicates(made, marks))
    return done.select("o_orderkey", "state", "state_rank", "at_risk", F.col("place").cast("bigint").alias("place"))


@query(_RECEIPTS + """SELECT o_custkey AS statement_id, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (state = 'filed') AS filed, count(*) FILTER (state = 'unverified') AS unverified,
count(*) FILTER (state <> 'filed') AS needs_you, CAST(coalesce(sum(CASE WHEN state <> 'filed' THEN abs(amount) END), 0) AS BIGINT) AS at_risk FROM s GROUP BY o_custkey""")
def queue_headline(spark, sf_dir):
    return queue.headline(order_queue(spark, sf_dir))


# Decisions and ledgers. Every tenth item was decided on the figures it shows, every other tenth on figures since changed.


def order_decisions(made: DataFrame) -> DataFrame:
    k = F.col("row")
    stale = F.col("seen").withField("charge_cents", F.col("seen.charge_cents") + 1)
    return made.filter(k % 10 < 2).select(F.when(k % 10 == 0, F.col("seen")).otherwise(stale).alias("seen"), F.when(k % 20 < 10, F.lit("accept_as_printed")).otherwise(F.lit("ignore")).alias("action"), F.lit("seen it").alias("note"), F.lit("2024-05-06T00:00:00").alias("at"), k.alias("line_no"))


@query(_RECEIPTS + "SELECT o_orderkey, state FROM s WHERE o_orderkey % 10 <> 0")
def outstanding(spark, sf_dir):
    made = order_queue(spark, sf_dir)
    return decisions.outstanding(made, order_decisions(made)).select("o_orderkey", "state")


def _shown(c: str) -> str:
    """SQL for cents as a decimal string."""
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


_WHY = f"""
w AS (SELECT *, CASE WHEN c1 IS NULL THEN 'items or subtotal not stated' ELSE 'items ' || {_shown("items")} || ', subtotal ' || {_shown("subtotal")} END AS d1,
  CASE WHEN c2 IS NULL THEN 'subtotal or total not stated' ELSE 'built ' || {_shown("(subtotal + coalesce(tax, 0))")} || ', total ' || {_shown("total")} END AS d2,
  CASE WHEN c3 IS NULL THEN 'no total, or neither tax nor tip' WHEN c3 THEN 'tax and tip fit the total' ELSE 'a part of ' || {_shown("tax")} || ' in a total of ' || {_shown("total")} END AS d3,
  CASE WHEN total IS NULL THEN 'no receipt with a total' WHEN foreign_ THEN 'receipt in USD, charge in EUR' ELSE 'receipt ' || {_shown("total")} || ', charged ' || {_shown("abs(amount)")} END AS d4,
  coalesce(c1, false)::INT + coalesce(c2, false)::INT + coalesce(c3, false)::INT + coalesce(c4, false)::INT AS passed FROM s),
y AS (SELECT *, CASE WHEN state = 'ambiguous' THEN '2 receipts fit the amount, none can be chosen'
  WHEN c1 = false THEN d1 WHEN c2 = false THEN d2 WHEN c3 = false THEN d3 WHEN c4 = false THEN d4
  WHEN verdict = 'reconciled' THEN passed || ' checks agree'
  WHEN generated AND passed > 0 THEN 'a model wrote these figures; that they agree is no evidence, and no charge matches them'
  WHEN total IS NULL THEN d4 WHEN c1 IS NULL THEN d1 WHEN c2 IS NULL THEN d2 WHEN c3 IS NULL THEN d3 WHEN c4 IS NULL THEN d4 ELSE 'nothing to check' END AS item_why FROM w)
"""
_LEDGER = _RECEIPTS + "," + _WHY + f""", g AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, '=Order, ' || o_orderkey AS description, {_shown("amount")} AS amount_text,
CASE WHEN o_orderkey % 20 = 0 THEN 'accepted' WHEN state = 'failed' THEN 'does-not-reconcile' WHEN state = 'ambiguous' THEN 'ambiguous' WHEN state = 'unverified' THEN 'unchecked' ELSE 'reconciled' END AS verdict_tag,
CASE WHEN o_orderkey % 20 = 0 THEN 'accepted by you on 2024-05-06: seen it; ' ELSE '' END || item_why AS why,
CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey ELSE 'Shop' END AS receipt,
'lines_sum_to_subtotal=' || CASE WHEN c1 THEN 'ok' WHEN NOT c1 THEN 'FAILED' ELSE 'unrun' END || '; subtotal_builds_total=' || CASE WHEN c2 THEN 'ok' WHEN NOT c2 THEN 'FAILED' ELSE 'unrun' END ||
'; parts_within_total=' || CASE WHEN c3 THEN 'ok' WHEN NOT c3 THEN 'FAILED' ELSE 'unrun' END || '; receipt_matches_charge=' || CASE WHEN c4 THEN 'ok' WHEN NOT c4 THEN 'FAILED' ELSE 'unrun' END AS checks FROM y)
"""


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_queue(spark, sf_dir)
    return decisions.ledger_rows(made, order_decisions(made))


@query(_LEDGER + "SELECT o_orderkey AS row, date, description, amount_text AS amount, verdict_tag AS verdict, why, receipt, checks FROM g")
def ledger_rows(spark, sf_dir):
    return order_ledger(spark, sf_dir).select("row", "date", "description", "amount", "verdict", "why", "receipt", "checks")


@query(_LEDGER + "SELECT date, '''' || description AS description, amount_text AS amount, 'ledgerloom:' || verdict_tag AS verdict, why, receipt, checks FROM g")
def sink_generic(spark, sf_dir):
    return sinks.generic(order_ledger(spark, sf_dir))


@query(_LEDGER + "SELECT date AS \"Date\", '''' || description AS \"Payee\", '#ledgerloom-' || verdict_tag || ' ' || why AS \"Notes\", amount_text AS \"Amount\" FROM g")
def sink_actual(spark, sf_dir):
    return sinks.actual(order_ledger(spark, sf_dir))


@query(_LEDGER + "SELECT date, '''' || description AS description, amount_text AS amount, 'ledgerloom:' || verdict_tag AS tags, why || ' | receipt: ' || receipt || ' | ' || checks AS notes FROM g")
def sink_firefly(spark, sf_dir):
    return sinks.firefly(order_ledger(spark, sf_dir))


@query(_LEDGER + """SELECT o_orderkey AS row, date || ' ' || CASE WHEN verdict_tag IN ('reconciled', 'accepted') THEN '*' ELSE '!' END || ' "''' || description || '"' || chr(10) || '  ledgerloom-verdict: "' || verdict_tag || '"' || chr(10) ||
'  ledgerloom-why: "' || why || '"' || chr(10) || '  ledgerloom-receipt: "' || receipt || '"' || chr(10) || '  Assets:Bank:Checking  ' || amount_text || ' ' || CASE WHEN o_orderkey % 19 = 0 THEN 'EUR' ELSE 'USD' END || chr(10) || '  Expenses:Unknown' || chr(10) AS value FROM g""")
def sink_beancount(spark, sf_dir):
    return sinks.beancount(order_ledger(spark, sf_dir)).select("row", "value")


@query(_LEDGER + "SELECT verdict_tag AS verdict, count(*) AS n FROM g GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return sinks.verdict_counts(order_ledger(spark, sf_dir))


@query("""
WITH l AS (SELECT user_id, row_number() OVER w AS n, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS body, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END AS bad FROM l)
SELECT user_id AS log_id, min(CASE WHEN bad = 'x' THEN n END) IS NULL AS intact, min(CASE WHEN bad = 'x' THEN n END) AS broken_at, count(*) AS entries FROM p GROUP BY user_id
""")
def chain_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    # A line names the digest of the line before it, so each log is written line by line.
    line = F.expr("""aggregate(ids, named_struct('prev', repeat('0', 64), 'out', cast(array() as array<string>)), (acc, x) -> named_struct(
      'prev', sha2(concat('{"prev":"', if(x % 97 = 0, 'x', acc.prev), '","id":', x, '}'), 256),
      'out', concat(acc.out, array(concat('{"prev":"', if(x % 97 = 0, 'x', acc.prev), '","id":', x, '}')))), acc -> acc.out)""")
    logs = rows.groupBy(F.col("user_id").alias("log_id")).agg(F.array_sort(F.collect_list("event_id")).alias("ids")).select("log_id", F.posexplode(line).alias("at", "line"))
    return decisions.verify_chain(logs.select("log_id", (F.col("at") + 1).cast("bigint").alias("line_no"), "line"))


# Texts: receipts and statements written from orders, then read back.

_TEXTS = """
WITH i AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS items, count(*) AS n FROM lineitem GROUP BY l_orderkey)
"""


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit("   "), format_cents(cents_of("l_extendedprice")))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.sum(cents_of("l_extendedprice")).alias("sum"))
    tax = F.expr("sum div 10")
    text = F.concat_ws("\n", F.lit("Corner Trading House"), F.col("lines"), F.concat(F.lit("SUB TOTAL  "), format_cents(F.col("sum"))), F.concat(F.lit("Tax 10.00%  "), format_cents(tax)), F.concat(F.lit("TOTAL EUR  "), format_cents(F.col("sum") + tax)), F.concat(F.lit("Cash  "), format_cents(F.col("sum") + tax + 500)), F.lit("Change 5.00"))
    return items.select(F.col("l_orderkey").alias("receipt_id"), text.alias("text"), (F.col("l_orderkey") % 10 == 0).alias("degraded"))


@query(_TEXTS + "SELECT l_orderkey AS receipt_id, CASE WHEN l_orderkey % 10 <> 0 THEN items END AS subtotal_cents, CASE WHEN l_orderkey % 10 <> 0 THEN items // 10 END AS tax_cents, CASE WHEN l_orderkey % 10 <> 0 THEN items + items // 10 END AS total_cents, 'Corner Trading House' AS merchant, 'EUR' AS currency, n AS n_items FROM i")
def receipt_fields(spark, sf_dir):
    read = extract.receipts(receipt_texts(spark, sf_dir))
    return read.select("receipt_id", "subtotal_cents", "tax_cents", "total_cents", "merchant", "currency", F.size("items").cast("bigint").alias("n_items"))


_TOKENS = f"""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS number, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) * 100 AS b FROM lineitem),
x AS (SELECT k, number, 0 AS part, a AS cents, CASE WHEN k % 4 = 1 THEN ',' ELSE '.' END AS own FROM l
  UNION ALL SELECT k, number, 1, -b, CASE WHEN k % 4 IN (0, 1) THEN CASE WHEN k % 4 = 1 THEN ',' ELSE '.' END ELSE ',' END FROM l
  UNION ALL SELECT k, count(*), 0, CAST(sum(a) AS BIGINT), '.' FROM l WHERE k % 4 = 3 GROUP BY k),
v AS (SELECT k, CASE WHEN count(*) < 3 OR count(*) FILTER (own = '.') = count(*) FILTER (own = ',') THEN '' WHEN count(*) FILTER (own = '.') > count(*) FILTER (own = ',') THEN '.' ELSE ',' END AS mark FROM x GROUP BY k),
t AS (SELECT *, row_number() OVER (PARTITION BY k, number ORDER BY part) - 1 AS place FROM x JOIN v USING (k) WHERE mark = '' OR mark = own)
"""


@query(_TOKENS + "SELECT k AS receipt_id, CAST(number AS INT) AS number, CAST(place AS INT) AS place, cents, mark FROM t")
def amount_tokens(spark, sf_dir):
    """Two amounts and a rate on each line, with points, commas, both, and both with a sum that decides for points."""
    k = F.col("l_orderkey")
    comma = lambda text: F.translate(text, ".", ",")
    a, b = format_cents(cents_of("l_extendedprice")), format_cents(-F.col("l_quantity").cast("bigint") * 100)
    line = F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit(": "), F.when(k % 4 == 1, comma(a)).otherwise(a), F.lit(" | "), F.when(k % 4 == 0, b).otherwise(comma(b)), F.lit(" | 7.50% | 3.4.05"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", line.alias("line")))).alias("lines"), F.sum(cents_of("l_extendedprice")).alias("sum"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n"), F.when(F.col("l_orderkey") % 4 == 3, F.concat(F.lit("\r\nSum: "), format_cents(F.col("sum")))).otherwise(F.lit("")))
    lines = extract.amounts_of(rows.select(F.col("l_orderkey").alias("receipt_id"), text.alias("text")))
    return lines.select("receipt_id", "number", "mark", F.posexplode("amounts").alias("place", "cents")).select("receipt_id", "number", "place", "cents", "mark")


_PARSED = "SELECT o_custkey AS statement_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row, CAST(o_orderdate AS DATE) AS date, {name} AS description, -CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents FROM orders"


@query(_PARSED.format(name="'Order, \"no\" ' || o_orderkey"))
def statements_csv(spark, sf_dir):
    cell = F.concat(F.lit('"Order, ""no"" '), F.col("o_orderkey").cast("string"), F.lit('"'))
    semicolon = F.col("o_custkey") % 2 == 0
    mark = F.when(semicolon, F.lit(";")).otherwise(F.lit(","))
    amount = F.when(semicolon, F.translate(format_cents(F.col("amount_cents")), ".", ",")).otherwise(format_cents(F.col("amount_cents")))
    line = F.concat_ws("", F.date_format("date", "yyyy-MM-dd"), mark, cell, mark, amount)
    rows = order_lines(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(semicolon, F.lit("Datum;Beschreibung;Betrag")).otherwise(F.lit("My account\nDate,Description,Amount (EUR)"))
    files = rows.select(F.col("o_custkey").cast("string").alias("statement_id"), F.concat_ws("\n", head, "body").alias("text"))
    return parse_csv(files).lines.select(F.col("statement_id").cast("bigint").alias("statement_id"), F.col("row").cast("bigint").alias("row"), "date", "description", "amount_cents")


@query(_PARSED.format(name="'Order ' || o_orderkey"))
def statements_ofx(spark, sf_dir):
    block = F.concat(F.lit("<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000<TRNAMT>"), format_cents(F.col("amount_cents")), F.lit("<NAME>Order "), F.col("o_orderkey").cast("string"), F.lit("</STMTTRN>"))
    rows = order_lines(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", block.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    files = rows.select(F.col("o_custkey").cast("string").alias("statement_id"), F.concat(F.lit("<OFX><CURDEF>EUR<BANKTRANLIST>"), "body", F.lit("</BANKTRANLIST></OFX>")).alias("text"))
    return parse_ofx(files).lines.select(F.col("statement_id").cast("bigint").alias("statement_id"), F.col("row").cast("bigint").alias("row"), "date", "description", "amount_cents")


_FILES = """
WITH b AS (SELECT o_custkey AS k, o_custkey % 9 AS kind, row_number() OVER w AS row, -CAST(round(o_totalprice * 100) AS BIGINT) AS a, 100000000 + sum(-CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS balance FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
f AS (SELECT k, kind, count(*) AS n, sum(CASE WHEN kind IN (0, 1) AND row % 2 = 0 THEN -a ELSE a END) AS s, CASE WHEN kind IN (0, 6) THEN sum(balance) END AS balances FROM b GROUP BY k, kind),
c AS (SELECT *, CASE WHEN kind = 1 AND n > 1 THEN 'both_sides' WHEN kind = 2 AND n > 1 OR kind = 8 THEN 'unreadable_amount' WHEN kind = 3 THEN 'no_money_column' WHEN kind = 4 THEN 'no_rows' WHEN kind = 5 THEN 'no_amounts' WHEN kind = 7 THEN 'dates_unsettled' END AS code FROM f)
"""


@query(_FILES + """SELECT k AS statement_id, code, CASE WHEN code IS NULL THEN NULL WHEN kind IN (1, 2) THEN 2 WHEN kind = 8 THEN 1 ELSE 0 END AS refused_row, CASE WHEN code IS NULL THEN n ELSE 0 END AS n_lines,
CASE WHEN code IS NULL THEN CAST(s AS BIGINT) END AS sum_cents, CASE WHEN code IS NULL THEN CAST(balances AS BIGINT) END AS balances_cents, CASE WHEN code IS NULL AND kind = 6 THEN 'EUR' END AS currency FROM c""")
def statement_files(spark, sf_dir):
    """Debit and credit columns, balances, comma decimals with a currency, and every way in which a file is refused."""
    rows = order_lines(spark, sf_dir).withColumn("kind", F.col("o_custkey") % 9)
    kind, second = F.col("kind"), F.col("row") % 2 == 0
    size, signed, balance = format_cents(F.abs("amount_cents")), format_cents(F.col("amount_cents")), format_cents(F.col("balance_cents"))
    day, comma = F.date_format("date", "yyyy-MM-dd"), lambda c: F.concat(F.translate(c, ".", ","), F.lit(" €"))
    both = (kind == 1) & (F.col("row") == 2)
    debit, credit = F.when(second & ~both, F.lit("0.00")).otherwise(size), F.when(second | both, size).otherwise(F.lit(""))
    name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    line = (
        F.when(kind == 0, F.concat_ws(",", day, name, debit, credit, balance))
        .when(kind == 1, F.concat_ws(",", day, name, debit, credit))
        .when(kind == 2, F.concat_ws(",", day, name, F.when(F.col("row") == 2, F.lit("n/a")).otherwise(signed)))
        .when(kind == 6, F.concat_ws(";", day, name, comma(signed), comma(balance)))
        .when(kind == 7, F.concat_ws(",", F.lit("05/06/2024"), name, signed))
        .when(kind == 8, F.concat(F.lit("<STMTTRN><TRNAMT>"), F.when(F.col("row") == 1, F.lit("lots")).otherwise(signed), F.lit("<NAME>"), name, F.lit("</STMTTRN>")))
        .otherwise(F.concat_ws(",", day, name))
    )
    heads = {0: "Date,Description,Money out,Money in,Balance", 1: "Date,Description,Debit,Credit", 2: "Date,Description,Amount", 3: "Date,Description", 5: "Date,Description,Amount", 6: "Datum;Verwendungszweck;Betrag;Saldo", 7: "Date,Description,Amount", 8: "<OFX>"}
    head = F.lit(" ")
    for k, text in heads.items():
        head = F.when(kind == k, F.lit(text)).otherwise(head)
    bodies = rows.groupBy("o_custkey", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    files = bodies.select(F.col("o_custkey").alias("statement_id"), F.when(kind.isin(4, 5), head).otherwise(F.concat_ws("\n", head, "body")).alias("text"))
    # Lines and refusals are told from one reading of the files.
    parsed = statements_of(written(statement_rows(files.withColumn("statement_id", F.col("statement_id").cast("string"))), "statement-rows"))
    lines = parsed.lines.groupBy("statement_id").agg(F.count("*").alias("n_lines"), F.sum("amount_cents").alias("sum_cents"), F.sum("balance_cents").alias("balances_cents"), F.max("currency").alias("currency"))
    every = files.select(F.col("statement_id").cast("string").alias("statement_id")).join(parsed.refusals, "statement_id", "left").join(lines, "statement_id", "left")
    return every.select(F.col("statement_id").cast("bigint").alias("statement_id"), "code", F.col("row").alias("refused_row"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "sum_cents", "balances_cents", "currency")


_RULES = """
WITH i AS (SELECT l_orderkey AS k, l_orderkey % 7 AS kind, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s FROM lineitem GROUP BY l_orderkey),
f AS (SELECT k, kind, 'tax' AS field, s // 11 AS value, 1.0 AS confidence, 2 AS line_number, 'labelled' AS how FROM i WHERE kind = 0
  UNION ALL SELECT k, kind, 'total', s, 1.0, 1, 'labelled' FROM i WHERE kind = 0
  UNION ALL SELECT k, kind, 'total', s, 0.55, 1, 'handed over' FROM i WHERE kind = 1
  UNION ALL SELECT k, kind, 'total', s + 500, 0.55, 2, 'largest near the end' FROM i WHERE kind = 2
  UNION ALL SELECT k, kind, 'total', s, 0.2, 2, 'labelled' FROM i WHERE kind = 3
  UNION ALL SELECT k, kind, 'total', NULL, 0.0, NULL, 'no amount' FROM i WHERE kind = 4
  UNION ALL SELECT k, kind, unnest(['subtotal', 'tip', 'discount', 'fees', 'total']), unnest([s, s // 20, 150, 99, s + s // 20 - 51]), 1.0, unnest([2, 3, 4, 5, 6]), 'labelled' FROM i WHERE kind = 5
  UNION ALL SELECT k, kind, 'total', s, 0.2, 1, 'largest near the end' FROM i WHERE kind = 6)
"""


def ruled_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tax that is included, totals handed over, guessed, doubtful and missing, and every labelled part."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt_id")).agg(F.sum(cents_of("l_extendedprice")).alias("s"))
    kind, amount, plus = F.col("receipt_id") % 7, format_cents(F.col("s")), format_cents(F.col("s") + 500)
    tip = F.expr("s div 20")
    lines = {
        0: ("Shop", F.concat(F.lit("Total  "), amount), F.concat(F.lit("of which VAT 10% is "), format_cents(F.expr("s div 11")))),
        1: ("Shop", F.concat(F.lit("Amount paid "), amount)),
        2: ("Shop", F.concat(F.lit("Tea "), amount), F.concat(F.lit("Cash "), plus), F.lit("Change 5.00")),
        3: ("Shop", "Total 1.00", F.concat(F.lit("TOTAL DUE "), amount)),
        5: ("Shop", F.concat(F.lit("Tea "), amount), F.concat(F.lit("Sub-Total "), amount), F.concat(F.lit("Gratuity "), format_cents(tip)), F.lit("Coupon 1.50"), F.lit("Service fee 0.99"), F.concat(F.lit("Balance due "), format_cents(F.col("s") + tip - 51))),
        6: ("Shop", F.concat(F.lit("Tea "), amount)),
    }
    text = F.lit("nothing\nto read")
    for k, parts in lines.items():
        text = F.when(kind == k, F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise(text)
    return items.select("receipt_id", text.alias("text"), kind.isin(3, 6).alias("degraded"))


@query(_RULES + "SELECT k AS receipt_id, field, CAST(value AS BIGINT) AS value_cents, CAST(confidence AS DOUBLE) AS confidence, line_number, how FROM f")
def receipt_rules(spark, sf_dir):
    return extract.fields(extract.readings(ruled_receipts(spark, sf_dir))).select("receipt_id", "field", "value_cents", "confidence", "line_number", "how")


@query(_RULES + "SELECT k AS receipt_id, CASE WHEN kind IN (1, 2, 3, 6) THEN 'total' ELSE '' END AS doubtful, kind IN (0, 5) AS trusted FROM i")
def receipts_for_a_person(spark, sf_dir):
    made = extract.receipts(ruled_receipts(spark, sf_dir))
    return made.select("receipt_id", F.array_join("doubtful", ",").alias("doubtful"), F.col("total_cents").isNotNull().alias("trusted"))


_WORDS = """
WITH w AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) AS line, 'p' || l_partkey AS a, 'q' || CAST(l_quantity AS BIGINT) AS b, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 1000) AS INT) AS c FROM lineitem)
"""


def words_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words a line, the right one given first."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount")
    q, line = F.col("l_quantity").cast("int"), F.col("line")
    left = F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), F.lit(90).alias("confidence"), F.lit(10).alias("left"), (line * 20).alias("top"), (q + 1).alias("width"), F.lit(12).alias("height"))
    right = F.struct(F.concat(F.lit("q"), q.cast("string")).alias("text"), F.round(F.col("l_discount") * 1000).cast("int").alias("confidence"), (q + 30).alias("left"), (line * 20 + 1).alias("top"), F.lit(25).alias("width"), (F.lit(8) + line).alias("height"))
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))
    return lines.select(F.col("l_orderkey").alias("doc_id"), "line", F.inline(F.array(right, left)))


@query(_WORDS + """SELECT doc_id AS receipt_id, string_agg(a || ' ' || b, chr(10) ORDER BY line) AS text, count(*) FILTER (c < 60) > 0.2 * 2 * count(*) OR 2 * count(*) < 8 AS degraded FROM w GROUP BY doc_id""")
def assembled_words(spark, sf_dir):
    return documents.assemble_words(words_read(spark, sf_dir)).select("receipt_id", "text", "degraded")


@query(_WORDS + 'SELECT doc_id, line, 10 AS "left", line * 20 AS "top", q + 55 AS "right", greatest(line * 20 + 12, line * 20 + 9 + line) AS "bottom" FROM w')
def line_boxes(spark, sf_dir):
    return extract.boxes(words_read(spark, sf_dir))


# Subset sums: an order's line prices and their total, whole, a cent off, with one digit misread, or with one price missing.

_SUMS = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(round(l_quantity) AS BIGINT) * 100 + l_linenumber) AS s FROM lineitem GROUP BY l_orderkey)
SELECT k AS receipt_id, n + 1 AS n_amounts, CASE WHEN n < 2 THEN NULL WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 7 ELSE 100000 END AS gap, CASE WHEN n < 2 THEN 'too few amounts' WHEN k % 3 = 0 THEN 'exact' WHEN k % 3 = 1 THEN 'near' ELSE 'far' END AS verdict FROM l
"""


@query(_SUMS)
def amounts_that_sum(spark, sf_dir):
    """The total is the sum, seven cents over it, or far over it (no single digit closes a gap of a thousand)."""
    price = F.round("l_quantity").cast("bigint") * 100 + F.col("l_linenumber")
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt_id")).agg(F.array_join(F.collect_list(format_cents(price)), "\n").alias("lines"), F.sum(price).alias("s"))
    kind = F.col("receipt_id") % 3
    total = F.col("s") + F.when(kind == 0, F.lit(0)).when(kind == 1, F.lit(7)).otherwise(F.lit(100_000))
    return extract.arithmetic(orders.select("receipt_id", F.concat_ws("\n", "lines", F.concat(F.lit("Sum "), format_cents(total))).alias("text")))


@query("""
WITH l AS (SELECT l_orderkey AS k, l_orderkey % 5 AS kind, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT CAST(kind AS VARCHAR) AS kind, count(*) AS texts, count(*) AS with_text, count(*) FILTER (n >= 3) AS with_amounts, list_sort(list(n))[count(*) // 2 + 1] AS median_amounts FROM l GROUP BY kind
""")
def amounts_by_kind(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(format_cents(cents_of("l_extendedprice"))), "\n").alias("text"))
    made = extract.amounts_by_kind(orders.select((F.col("l_orderkey") % 5).cast("string").alias("kind"), "text"))
    return made.withColumn("median_amounts", F.col("median_amounts").cast("bigint"))


@query(_LEDGER + """SELECT (SELECT count(*) FROM g) || ' transactions: ' || string_agg(n || ' ' || verdict_tag, ', ' ORDER BY list_position(['possible-duplicate', 'reconciled', 'accepted', 'does-not-reconcile', 'ambiguous', 'unchecked'], verdict_tag)) AS summary
FROM (SELECT verdict_tag, count(*) AS n FROM g GROUP BY 1)""")
def ledger_summary(spark, sf_dir):
    return sinks.summary(order_ledger(spark, sf_dir))


@query(_RECEIPTS + """SELECT o_orderkey, CASE WHEN c1 IS NOT NULL THEN items - subtotal END AS gap1, CASE WHEN c2 IS NOT NULL THEN subtotal + coalesce(tax, 0) - total END AS gap2, CASE WHEN c4 IS NOT NULL THEN total - abs(amount) END AS gap4 FROM v""")
def check_gaps(spark, sf_dir):
    made = verdict.reconcile(order_pairs(spark, sf_dir))
    return made.select("o_orderkey", *(F.element_at("checks", i)["gap"].alias(f"gap{i}") for i in (1, 2, 4)))


# Receipts whose sums don't close: a cent or two, a misread digit, a missing price.

_PRINTED = """
WITH c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n, CAST(round(l_extendedprice * 100) AS BIGINT) % 90000 + 1000 AS c FROM lineitem),
s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY k) AS BIGINT) AS total, CASE WHEN k % 5 = 2 AND n = 1 THEN CAST(replace(CAST(c AS VARCHAR), '8', '4') AS BIGINT) ELSE c END AS shown FROM c),
x AS (SELECT k, shown AS c FROM s WHERE NOT (k % 5 = 3 AND n = 1) UNION ALL SELECT k, total + CASE WHEN k % 5 = 1 THEN 7 ELSE 0 END FROM s WHERE n = 1),
a AS (SELECT k, list_sort(list(c), 'DESC') AS amounts FROM x GROUP BY k),
t AS (SELECT k, amounts[1] AS target, amounts[2:] AS parts FROM a),
m AS (SELECT k, target, parts, unnest(range(1, 1 << len(parts))) AS mask FROM t WHERE len(parts) > 1),
r AS (SELECT k, target, mask, list_sum(list_transform(range(0, len(parts)), lambda i: parts[i + 1] * ((mask >> i) & 1))) AS sum FROM m),
g AS (SELECT k, CAST(min(abs(sum - target)) AS BIGINT) AS gap FROM r GROUP BY k),
p AS (SELECT k, target, unnest(range(0, len(parts))) AS i, unnest(parts) AS part FROM t WHERE len(parts) > 1),
w AS (SELECT k, target, i, part, CAST(part AS VARCHAR) AS d, a, b FROM p, (VALUES ('4', '8'), ('8', '4'), ('1', '7'), ('7', '1'), ('3', '8'), ('8', '3'), ('5', '6'), ('6', '5'), ('0', '8'), ('8', '0'), ('9', '4'), ('6', '8')) AS v(a, b) WHERE contains(CAST(part AS VARCHAR), a)),
z AS (SELECT DISTINCT w.k FROM (SELECT *, target + part - CAST(substr(d, 1, instr(d, a) - 1) || b || substr(d, instr(d, a) + 1) AS BIGINT) AS wanted FROM w) w JOIN r ON r.k = w.k AND r.sum = wanted AND (r.mask >> i) & 1 = 1)
SELECT a.k AS receipt_id, len(amounts) AS n_amounts, gap, CASE WHEN len(amounts) < 3 THEN 'too few amounts' WHEN gap = 0 THEN 'exact' WHEN gap <= 10 OR z.k IS NOT NULL THEN 'near' ELSE 'far' END AS verdict
FROM a LEFT JOIN g USING (k) LEFT JOIN z ON z.k = a.k
"""


@query(_PRINTED)
def misread_amounts(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("n"), (cents_of("l_extendedprice") % 90000 + 1000).alias("c"))
    misread = F.replace(F.col("c").cast("string"), F.lit("8"), F.lit("4")).cast("bigint")
    shown = F.when((F.col("k") % 5 == 2) & (F.col("n") == 1), misread).otherwise(F.col("c"))
    printed = F.when(~((F.col("k") % 5 == 3) & (F.col("n") == 1)), format_cents(shown))
    total = format_cents(F.sum("c") + F.when(F.col("k") % 5 == 1, F.lit(7)).otherwise(F.lit(0)))
    texts = lines.groupBy("k").agg(F.concat_ws("\n", F.collect_list(printed), total).alias("text"))
    return extract.arithmetic(texts.withColumnRenamed("k", "receipt_id")).withColumn("n_amounts", F.col("n_amounts").cast("bigint"))


# Intake: one file for each order, of nine kinds; customers' figures make copies.

_FILES = """
WITH f AS (SELECT o_orderkey % 9 AS kind, 'in' || o_custkey AS inbox, 'in' || o_custkey || '/' || CASE WHEN o_orderkey % 9 = 6 THEN '.' ELSE '' END || o_orderkey || (['.csv', '.CSV', '.txt', '.pdf', '.pdf', '.png', '.txt', '.xyz', '.ofx'])[o_orderkey % 9 + 1] AS path,
  CASE o_orderkey % 9 WHEN 0 THEN 'Date,Amount' || chr(10) || '2024-01-01,' || o_custkey || '.00' || chr(10) WHEN 1 THEN 'just,a table,' || o_custkey WHEN 2 THEN 'Shop é' || chr(10) || 'Total ' || o_custkey
    WHEN 3 THEN '%PDF-1.4 stream' || chr(10) || 'BT (Total) Tj [(' || o_custkey || ') -20 (.50)] TJ ET' || chr(10) || 'endstream' WHEN 4 THEN '%PDF-1.4 /Subtype /Image ' || o_custkey WHEN 5 THEN 'x' WHEN 8 THEN '<OFX><STMTTRN>' || o_custkey ELSE '' || o_custkey END AS content FROM orders),
o AS (SELECT inbox, path, CASE WHEN kind IN (0, 8) THEN 'statement' WHEN kind IN (6, 7) THEN 'ignored' ELSE 'receipt' END AS kind,
  CASE kind WHEN 4 THEN 'a scan without a text layer' WHEN 5 THEN 'no engine for images is installed' WHEN 6 THEN 'hidden' WHEN 7 THEN 'unknown kind of file' END AS reason, sha256(content) AS digest,
  CASE kind WHEN 1 THEN content WHEN 2 THEN content WHEN 3 THEN 'Total' || chr(10) || regexp_extract(content, '\\[\\(([0-9]+)', 1) || '.50' WHEN 4 THEN '' END AS text,
  CASE WHEN kind BETWEEN 1 AND 4 THEN kind IN (1, 4) END AS degraded, CASE WHEN kind IN (1, 2) THEN 'text' WHEN kind IN (3, 4) THEN 'pdf' END AS reader FROM f)
"""


def inbox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("o_orderkey") % 9, F.col("o_custkey").cast("string")
    name = F.concat(F.when(kind == 6, F.lit(".")).otherwise(F.lit("")), F.col("o_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, (".csv", ".CSV", ".txt", ".pdf", ".pdf", ".png", ".txt", ".xyz", ".ofx"))), (kind + 1).cast("int")))
    content = (
        F.when(kind == 0, F.concat(F.lit("Date,Amount\n2024-01-01,"), n, F.lit(".00\n")))
        .when(kind == 1, F.concat(F.lit("just,a table,"), n))
        .when(kind == 2, F.concat(F.lit("Shop é\nTotal "), n))
        .when(kind == 3, F.concat(F.lit("%PDF-1.4 stream\nBT (Total) Tj [("), n, F.lit(") -20 (.50)] TJ ET\nendstream")))
        .when(kind == 4, F.concat(F.lit("%PDF-1.4 /Subtype /Image "), n))
        .when(kind == 5, F.lit("x"))
        .when(kind == 8, F.concat(F.lit("<OFX><STMTTRN>"), n))
        .otherwise(n)
    )
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("in"), n, F.lit("/"), name).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query(_FILES + "SELECT * FROM o")
def inbox_read(spark, sf_dir):
    """Every file told apart and read: statements, texts, PDFs with and without a text layer, images, tables that are none."""
    return documents.read_inbox(inbox_files(spark, sf_dir))


@query(_FILES + "SELECT inbox, count(*) FILTER (kind = 'statement') AS statements, CASE count(*) FILTER (kind = 'statement') WHEN 0 THEN 'no statement' WHEN 1 THEN NULL ELSE 'more than one statement' END AS problem FROM o GROUP BY inbox")
def inbox_problems(spark, sf_dir):
    return documents.inbox_problems(documents.classify_inbox(inbox_files(spark, sf_dir)))


@query(_FILES + "SELECT receipt_id, reason, text FROM (SELECT path AS receipt_id, reason, CASE WHEN reason IS NULL THEN text END AS text FROM o WHERE kind = 'receipt')")
def inbox_receipts(spark, sf_dir):
    """Readable receipts with their texts, the others with their reasons."""
    texts, unreadable = documents.receipts_of(documents.read_inbox(inbox_files(spark, sf_dir)))
    return texts.select("receipt_id", "text").unionByName(unreadable, allowMissingColumns=True)


@query(_FILES + "SELECT path, digest, same_as FROM (SELECT path, digest, min(path) OVER (PARTITION BY digest) AS same_as FROM o) WHERE path <> same_as")
def inbox_copies(spark, sf_dir):
    return documents.copies(documents.read_inbox(inbox_files(spark, sf_dir), read=False))


@query("""SELECT 'r' || o_orderkey AS receipt_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, CASE WHEN o_orderkey % 2 = 0 THEN CAST(250 AS BIGINT) END AS tax_cents, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Shop ' || o_custkey END AS merchant,
'EUR' AS currency, true AS generated FROM orders WHERE o_orderkey % 7 <> 0""")
def model_replies(spark, sf_dir):
    """Replies with an object between other words; some hold none, some say what isn't a number."""
    k = F.col("o_orderkey")
    merchant = F.when(k % 5 != 0, F.concat(F.lit(', "merchant": "Shop '), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise(F.lit(""))
    tax = F.when(k % 2 == 0, F.lit("2.50")).otherwise(F.lit("lots"))
    raw = F.concat(F.lit('Sure:\n{"total": "'), format_cents(cents_of("o_totalprice")), F.lit('", "tax": "'), tax, F.lit('", "currency": "EUR"'), merchant, F.lit("} That is all."))
    replies = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), k.cast("string")).alias("path"), F.when(k % 7 == 0, F.lit("I can't read it.")).otherwise(raw).alias("raw"))
    return documents.read_replies(replies).select("receipt_id", "total_cents", "tax_cents", "merchant", "currency", "generated")


@query("""SELECT 'log' || user_id % 16 AS log, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS line_no, '{"id":' || event_id || '}' AS line FROM events""")
def decision_log(spark, sf_dir):
    """Logs written as files, one each, and scanned line by line."""
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("log"), (F.col("user_id") % 16).cast("string")).alias("log"), "event_id")
    where = scratch_path(spark, "logs")
    shown = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    lines.repartition("log").sortWithinPartitions("log", "event_id").select("log", shown.alias("value")).write.partitionBy("log").text(where)
    found = decisions.read_log(spark, where)
    return found.select(F.regexp_extract("log_id", "/log=(log[0-9]+)/", 1).alias("log"), F.col("line_no").cast("bigint").alias("line_no"), "line")
