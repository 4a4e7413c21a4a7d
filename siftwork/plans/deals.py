"""Queries of siftwork.operators.deals with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import money, refs
from siftwork.operators import deals
from siftwork.plans.registry import query
from siftwork.sources.adapters import table

KINDS = ("investment", "acquisition", "partnership", "licensing", "ipo", "joint_venture")


def reports(spark, d):
    """Orders as reports of deals: funds and companies in several spellings, some undisclosed, undated, without a size or in a registry."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    name = F.when(k % 11 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" "), "c_mktsegment"))
    return table(spark, d, "orders").join(people, c == F.col("c_custkey")).select(
        k.alias("deal_id"), pick(KINDS, c).alias("kind"), F.when(k % 13 == 0, deals.UNDISCLOSED).otherwise(F.concat(F.lit("Fund "), "c_mktsegment")).alias("actor"), F.lit(None).cast("string").alias("actor_key"),
        F.when(k % 29 != 0, F.concat(name, pick(("", " Inc", ", Ltd.", " (EU) Holdings"), k))).alias("counterparty"),
        F.when(k % 17 == 0, F.lower(F.concat(F.regexp_replace("n_name", " ", ""), "c_mktsegment"))).alias("counterparty_key"),
        F.when(k % 4 != 3, F.col("o_totalprice").cast("double") * F.when(k % 50 == 0, 100_000).otherwise(1_000)).alias("amount_usd"), F.when(k % 97 != 0, F.to_date("o_orderdate")).alias("announced_on"),
    )


_WORDS = r"""list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '\s*[(\[][^)\]]*[)\]]', ' ', 'g'), '[\s,.''’`"&!?/:;·_-]+'), lambda w: w <> '' AND NOT list_contains(["""
_WORDS += ", ".join(f"'{f}'" for f in refs.FORMS) + "], w))"
_SIDE = "struct_pack(f := array_to_string({0}, ''), w := {0}, k := {1})"


def _match(p: str, q: str) -> str:
    heads = lambda a, b: f"(length({a}.f) >= 4 AND starts_with({b}.f, {a}.f) AND {b}.w[1:len({a}.w)] = {a}.w)"
    return (
        f"(CASE WHEN {p}.k IS NOT NULL AND {q}.k IS NOT NULL THEN {p}.k = {q}.k ELSE ({p}.f <> '' AND {q}.f <> '' AND ({p}.f = {q}.f OR {heads(p, q)} OR {heads(q, p)})) "
        f"OR coalesce({p}.k = {q}.f, false) OR coalesce({q}.k = {p}.f, false) END)"
    )


_ALIKE = f"""x.kind = y.kind AND x.id <> y.id AND x.block = y.block AND coalesce(abs(datediff('day', x.announced_on, y.announced_on)) <= 21, true) AND len(x.s) = len(y.s)
  AND {_match('x.s[1]', 'y.s[1]')} AND (len(x.s) = 1 OR coalesce({_match('x.s[2]', 'y.s[2]')}, false))"""
_REPORTS = f"""reports AS (
  SELECT o_orderkey AS deal_id, [{", ".join(f"'{k}'" for k in KINDS)}][o_custkey % 6 + 1] AS kind, CASE WHEN o_orderkey % 13 = 0 THEN '{deals.UNDISCLOSED}' ELSE 'Fund ' || c_mktsegment END AS actor,
    CASE WHEN o_orderkey % 29 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN n_name ELSE n_name || ' ' || c_mktsegment END || ['', ' Inc', ', Ltd.', ' (EU) Holdings'][o_orderkey % 4 + 1] END AS counterparty,
    CASE WHEN o_orderkey % 17 = 0 THEN lower(replace(n_name, ' ', '') || c_mktsegment) END AS ckey,
    CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_totalprice AS DOUBLE) * CASE WHEN o_orderkey % 50 = 0 THEN 100000 ELSE 1000 END END AS amount_usd, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS announced_on
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, deal_id AS id, {_WORDS.format('actor')} AS wa, {_WORDS.format('counterparty')} AS wc FROM reports),
z AS (SELECT *, {_SIDE.format('wa', 'CAST(NULL AS VARCHAR)')} AS a, CASE WHEN counterparty IS NULL THEN {_SIDE.format('wa', 'CAST(NULL AS VARCHAR)')} ELSE {_SIDE.format('wc', 'ckey')} END AS c FROM w),
t AS (SELECT id, kind, actor, amount_usd, announced_on, CASE WHEN kind NOT IN ('partnership', 'joint_venture', 'licensing') THEN [c] WHEN counterparty IS NULL THEN [a] WHEN coalesce(a.k, a.f) <= coalesce(c.k, c.f) THEN [a, c] ELSE [c, a] END AS s FROM z),
u AS (SELECT *, unnest(list_distinct(list_concat(list_transform(s, lambda p: 'p:' || substr(p.f, 1, 3)), list_transform(list_filter(s, lambda p: p.k IS NOT NULL), lambda p: 'k:' || p.k)))) AS block FROM t)"""


def _closed(name: str, edges: str) -> str:
    return f"""{name}_e AS (SELECT DISTINCT a, b FROM ({edges})), {name}_r AS (SELECT a AS node, a AS seen FROM {name}_e UNION SELECT r.node, e.b FROM {name}_r r JOIN {name}_e e ON r.seen = e.a), {name} AS (SELECT node, min(seen) AS root FROM {name}_r GROUP BY node)"""


@query("deals_deduped", f"""WITH RECURSIVE {_REPORTS},
  {_closed('g', f"SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON {_ALIKE} WHERE (x.amount_usd IS NULL AND y.amount_usd IS NULL) OR greatest(x.amount_usd, y.amount_usd) <= 1.15 * least(x.amount_usd, y.amount_usd) AND x.amount_usd IS NOT NULL AND y.amount_usd IS NOT NULL")},
  v AS (SELECT u.*, coalesce(root, id) AS grp FROM u LEFT JOIN g ON id = node), fits AS (SELECT x.grp AS own, min(y.grp) AS b FROM v x JOIN v y ON {_ALIKE} WHERE x.amount_usd IS NULL AND y.amount_usd IS NOT NULL GROUP BY x.id, x.grp HAVING min(y.grp) = max(y.grp)),
  {_closed('h', "SELECT own AS a, b FROM fits UNION SELECT b, own FROM fits")},
  m AS (SELECT id, actor, amount_usd, announced_on, coalesce(h.root, g.root, id) AS grp FROM t LEFT JOIN g ON id = g.node LEFT JOIN h ON coalesce(g.root, id) = h.node)
  SELECT id AS deal_id, first_value(id) OVER (PARTITION BY grp ORDER BY CASE WHEN actor <> '{deals.UNDISCLOSED}' AND amount_usd IS NOT NULL THEN 0 WHEN actor <> '{deals.UNDISCLOSED}' THEN 1 ELSE 2 END, announced_on NULLS FIRST, id) AS lead_id, count(*) OVER (PARTITION BY grp) AS reports FROM m""")
def _(spark, d):
    return deals.deduped(reports(spark, d))


#: Spellings of rounds, and what each is. Fixed values.
ROUNDS = {
    "Series B": "시리즈 B", "시리즈B": "시리즈 B", "B라운드": "시리즈 B", "시리즈 C-2": "시리즈 C-2", "시리즈 A 브릿지": "시리즈 A 브릿지", "시리즈 F (IPO 전)": "시리즈 F", "Pre-A+": "프리 시리즈 A+", "시리즈 프리A": "프리 시리즈 A",
    "Seed": "시드", "Pre-seed": "프리시드", "Angel Round": "엔젤", "업무협약(MOU)": "MOU", "시리즈 B (추정)": None, "미상": None,
}


@query("deal_stages", f"""SELECT [{", ".join(f"'{r}'" if r else "NULL" for r in ROUNDS.values())}][o_orderkey % {len(ROUNDS)} + 1] AS stage, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1""")
def _(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ROUNDS)), (F.col("o_orderkey") % len(ROUNDS) + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", money.stage(raw).alias("stage"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("stated_sums", """SELECT o_orderkey, unnest([struct_pack(v := o_custkey * 1e8 + o_orderkey % 1000 * 1e4, c := 'USD'), struct_pack(v := o_orderkey * 1e6, c := 'EUR')], recursive := true) FROM orders""".replace("v :=", "value :=").replace("c :=", "currency :="))
def _(spark, d):
    """Sums of a line for each order, in Korean and in English."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = F.concat(c, F.lit("억 "), (k % 1000).cast("string"), F.lit("만 달러를 투자하고 €"), F.format_number(k, 0), F.lit(" million"))
    return table(spark, d, "orders").select("o_orderkey", F.inline(money.stated(line)))
