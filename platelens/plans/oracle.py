"""DuckDB SQL for every checked query (the independent oracle).

The SQL re-derives each result from the driver tables by its own route
(regexes, GROUP BY, window functions, a recursive Lloyd fixpoint, power iteration); it shares only
the fixed values (feature list, whitespace class, thresholds) with the Spark
code. Doubles that depend on the order of addition are rounded on both sides.
"""

from __future__ import annotations

from ..schema import FEATURES, WS_CLASS

WS = WS_CLASS
LISTED = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
IN_LIST = ", ".join(f"'{r}'" for r in LISTED)
K = 3


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def clean(x: str) -> str:
    c1 = f"(CASE WHEN prefix({x}, '\"') THEN {strip(f'substr({x}, 2)')} ELSE {x} END)"
    c2 = (f"(CASE WHEN suffix({c1}, '\"') AND NOT regexp_matches({c1}, '\\p{{Nd}}\"\\z') "
          f"THEN {strip(f'substr({c1}, 1, length({c1}) - 1)')} ELSE {c1} END)")
    c3 = strip(f"regexp_replace({c2}, '[®*,]', '', 'g')")
    return strip(f"regexp_replace({c3}, '{WS}+', ' ', 'g')")


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{WS}+'), lambda w: w <> '')"


DIRTY = """CASE p_partkey % 8
  WHEN 0 THEN '"' || p_name || '"'
  WHEN 1 THEN p_name || '®'
  WHEN 2 THEN p_name || ' *'
  WHEN 3 THEN replace(p_name, ' ', ', ')
  WHEN 4 THEN chr(160) || replace(p_name, ' ', ' ' || chr(160) || ' ') || chr(9)
  WHEN 5 THEN CAST(p_size AS VARCHAR) || '" ' || p_name
  WHEN 6 THEN p_name || ' ' || CAST(p_size AS VARCHAR) || '"'
  ELSE '"' || p_name || '"®' END"""

NOT_NULL = lambda cols: " AND ".join(f"{c} IS NOT NULL" for c in cols)
NUM_OK = lambda cols: " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols)

ITEM_COLS = ["id", "restaurant", "item", "calories", "total_fat", "sugar", "total_carb",
             "protein", "calcium", "fiber"]

BASE = f"""
li AS (
  SELECT l_partkey, max(l_extendedprice) AS total_fat, sum(l_quantity) AS sugar,
         max(l_discount) * 100.0::DOUBLE AS protein, max(l_tax) * 100.0::DOUBLE AS calcium,
         CAST(count(*) AS DOUBLE) AS fiber
  FROM lineitem GROUP BY l_partkey),
pf AS (SELECT * FROM part p LEFT JOIN li ON p.p_partkey = li.l_partkey),
raw AS (
  SELECT p_partkey AS id, p_brand AS restaurant, {DIRTY} AS item, p_retailprice AS calories,
         total_fat, sugar, CAST(p_size AS DOUBLE) AS total_carb, protein, calcium, fiber
  FROM pf),
items AS (
  SELECT id, restaurant, {clean('item')} AS item, calories, total_fat, sugar, total_carb,
         protein, calcium, fiber
  FROM raw
  WHERE {NOT_NULL(['id', 'restaurant', 'item'])}
    AND {NUM_OK(['calories', 'total_fat', 'sugar', 'total_carb', 'protein', 'calcium', 'fiber'])}),
dct AS (
  SELECT p_name AS item,
         arg_max_null(CASE WHEN p_size <= 45 THEN upper(p_name) || ' ' || CAST(p_size AS VARCHAR) END,
                      p_partkey) AS item_gr
  FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_name),
lex AS (
  SELECT word, max(upper(reverse(word))) AS word_tr
  FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
  WHERE length(word) >= 4 GROUP BY word),
names AS (SELECT DISTINCT item FROM items),
missing AS (SELECT n.item FROM names n WHERE NOT EXISTS (SELECT 1 FROM dct d WHERE d.item = n.item)),
mw AS (SELECT item, {split_words('item')} AS ws FROM missing),
words AS (SELECT item, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM mw),
fallback AS (
  SELECT m.item, coalesce(string_agg(coalesce(l.word_tr, w.word), ' ' ORDER BY w.pos), '') AS item_gr
  FROM missing m LEFT JOIN words w ON w.item = m.item LEFT JOIN lex l ON l.word = w.word
  GROUP BY m.item),
trans AS (SELECT item, item_gr FROM dct UNION ALL SELECT item, item_gr FROM fallback),
titems AS (SELECT i.*, t.item_gr FROM items i LEFT JOIN trans t ON t.item = i.item)"""


def with_base(body: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{extra}\n{body}"


def _z_ctes(source: str = "titems") -> str:
    means = ",\n    ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0::DOUBLE ELSE stddev_pop({f}) END AS s_{f}"
        for f in FEATURES)
    zs = ", ".join(f"(v.{f} - st.m_{f}) / st.s_{f} AS z_{f}" for f in FEATURES)
    return f""",
valid AS (SELECT * FROM {source} WHERE {NUM_OK(FEATURES)}),
st AS (SELECT {means} FROM valid),
z AS MATERIALIZED (SELECT v.id, {zs} FROM valid v, st)"""


def _dist(a: str, b: str) -> str:
    return " + ".join(f"({a}.z_{f} - {b}.z_{f}) * ({a}.z_{f} - {b}.z_{f})" for f in FEATURES)


def _lloyd_ctes(order: str = "id", k: int = K, source: str = "titems") -> str:
    """Lloyd steps from the k first rows by ``order`` until the squared moves of the
    centroids together are at most 1e-4 of the features' mean variance."""
    zc = ", ".join(f"z_{f}" for f in FEATURES)
    avgs = ", ".join(f"avg(z.z_{f}) AS z_{f}" for f in FEATURES)
    keep = ", ".join(f"coalesce(m.z_{f}, p.z_{f}) AS z_{f}" for f in FEATURES)
    moved = " + ".join(f"(coalesce(m.z_{f}, p.z_{f}) - p.z_{f}) ** 2" for f in FEATURES)
    spread = " + ".join(f"var_pop(z_{f})" for f in FEATURES)
    return f""",
tolerance AS MATERIALIZED (SELECT 1e-4 * ({spread}) / {len(FEATURES)} AS tol FROM z),
steps AS (
  SELECT 0 AS step, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS cluster, {zc}, true AS moved
  FROM (SELECT * FROM z ORDER BY {order} LIMIT {k})
  UNION ALL
  SELECT p.step + 1 AS step, p.cluster, {keep}, sum({moved}) OVER () > (SELECT tol FROM tolerance) AS moved
  FROM steps p LEFT JOIN (
    SELECT a.cluster, {avgs}
    FROM (SELECT z.id, first(c.cluster ORDER BY {_dist('z', 'c')}, c.cluster) AS cluster
          FROM z, steps c GROUP BY z.id) a JOIN z ON z.id = a.id
    GROUP BY a.cluster) m ON m.cluster = p.cluster
  WHERE p.moved),
cents AS MATERIALIZED (SELECT * FROM steps WHERE step = (SELECT max(step) FROM steps)),
fin AS MATERIALIZED (SELECT z.id, first(c.cluster ORDER BY {_dist('z', 'c')}, c.cluster) AS cluster
        FROM z, cents c GROUP BY z.id),
dessert AS (SELECT first(cluster ORDER BY z_sugar DESC, cluster) AS cluster FROM cents),
main AS (SELECT first(cluster ORDER BY z_calories + z_protein DESC, cluster) AS cluster
         FROM cents WHERE cluster <> (SELECT cluster FROM dessert)),
named AS (SELECT cluster, CASE WHEN cluster = (SELECT cluster FROM dessert) THEN 'Dessert'
                               WHEN cluster = (SELECT cluster FROM main) THEN 'Main'
                               ELSE 'Side' END AS category FROM cents),
categorized AS (SELECT t.*, f.cluster, n.category FROM {source} t
                LEFT JOIN fin f ON f.id = t.id LEFT JOIN named n ON n.cluster = f.cluster)"""


def _pca_ctes(squarings: int = 12) -> str:
    """Two leading eigenvectors of the correlation matrix: squaring it over and
    over (scaled to trace 1) leaves the projector on the first; deflation gives
    the second. Columns v1_i and v2_i of the one-row table ``axes``, the
    largest entry of either positive."""
    d = range(len(FEATURES))
    e = lambda i, j: f"e_{min(i, j)}_{max(i, j)}"
    pairs = [(i, j) for i in d for j in d if i <= j]
    trace = " + ".join(e(i, i) for i in d)

    def power(name: str, source: str) -> str:
        parts, last = [], source
        for t in range(squarings):
            square = ", ".join(f"{' + '.join(f'{e(i, k)} * {e(k, j)}' for k in d)} AS {e(i, j)}" for i, j in pairs)
            scaled = ", ".join(f"{e(i, j)} / ({trace}) AS {e(i, j)}" for i, j in pairs)
            parts.append(f"{name}{t} AS MATERIALIZED (SELECT {scaled} FROM (SELECT {square} FROM {last}))")
            last = f"{name}{t}"
        return ",\n".join(parts), last

    one, p1 = power("pa", "corr0")
    two, p2 = power("pb", "corr1")
    lam = " + ".join(f"c.{e(i, j)} * p.{e(i, j)}" for i in d for j in d)
    less = ", ".join(f"c.{e(i, j)} - ({lam}) * p.{e(i, j)} AS {e(i, j)}" for i, j in pairs)

    def axis(n: int, p: str) -> str:
        top = f"greatest({', '.join(f'{p}.{e(i, i)}' for i in d)})"
        return ", ".join("CASE " + " ".join(
            f"WHEN {p}.{e(b, b)} = {top} THEN {p}.{e(b, i)} / sqrt({p}.{e(b, b)})" for b in d) + f" END AS v{n}_{i}" for i in d)

    corr = ", ".join(f"avg(z_{FEATURES[i]} * z_{FEATURES[j]}) AS {e(i, j)}" for i, j in pairs)
    return f""",
corr0 AS MATERIALIZED (SELECT {corr} FROM z),
{one},
corr1 AS MATERIALIZED (SELECT {less} FROM corr0 c, {p1} p),
{two},
axes AS MATERIALIZED (SELECT {axis(1, p1)}, {axis(2, p2)} FROM {p1}, {p2})"""


def _r(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


def _top_items(listed: bool) -> str:
    where = f"WHERE restaurant IN ({IN_LIST})" if listed else ""
    return f"""
SELECT restaurant, item, item_gr, max_calories, rank,
       item || '<br>' || item_gr || '<br>' || 'Calories: ' ||
         CASE WHEN max_calories = floor(max_calories) THEN CAST(CAST(max_calories AS BIGINT) AS VARCHAR)
              ELSE CAST(max_calories AS VARCHAR) END AS label,
       item || '<br>' || item_gr AS label_short
FROM (
  SELECT restaurant, item, max(calories) AS max_calories,
         arg_max_null(item_gr, (calories, -id)) AS item_gr,
         row_number() OVER (PARTITION BY restaurant ORDER BY max(calories) DESC, item) AS rank
  FROM titems {where}
  GROUP BY restaurant, item)
WHERE rank <= 5"""


def _max_calorie(listed: bool) -> str:
    where = f"WHERE restaurant IN ({IN_LIST})" if listed else ""
    return with_base(f"""
SELECT restaurant, top.item AS item, top.item_gr AS item_gr, max_calories,
       {_r('avg_carbohydrates')} AS avg_carbohydrates, top.item || '<br>' || top.item_gr AS label
FROM (SELECT restaurant, arg_max_null({{'item': item, 'item_gr': item_gr}}, (calories, -id)) AS top,
             max(calories) AS max_calories, avg(total_carb) AS avg_carbohydrates
      FROM titems {where} GROUP BY restaurant)""")


def _share(listed: bool) -> str:
    where = f"WHERE restaurant IN ({IN_LIST})" if listed else ""
    return with_base(f"""
SELECT restaurant, {_r('a')} AS avg_carbohydrates, {_r('a / sum(a) OVER ()')} AS share
FROM (SELECT restaurant, avg(total_carb) AS a FROM items {where} GROUP BY restaurant)""")


MENU_NUM = ["calories", "cal_fat", "total_fat", "sat_fat", "trans_fat", "cholesterol", "sodium",
            "total_carb", "fiber", "sugar", "protein", "vit_a", "vit_c", "calcium"]


def _menu_typed(order: str = "p_partkey", vit_a: str = "CAST(p_size AS DOUBLE)") -> str:
    """The menu as load_items must produce it (typed, kept rows, file-order ids)."""
    return f"""
SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS id,
       p_brand AS restaurant, {clean(DIRTY)} AS item,
       p_retailprice AS calories, CAST(p_size * 9 AS DOUBLE) AS cal_fat, total_fat,
       protein / 2 AS sat_fat, 0.0::DOUBLE AS trans_fat, CAST(p_size * 3 AS DOUBLE) AS cholesterol,
       p_retailprice * 2 AS sodium, CAST(p_size AS DOUBLE) AS total_carb, fiber, sugar, protein,
       {vit_a} AS vit_a, CAST(p_size * 2 AS DOUBLE) AS vit_c,
       CASE WHEN p_size = 3 THEN NULL ELSE calcium END AS calcium,
       'Other' AS salad, CAST(NULL AS VARCHAR) AS item_gr, CAST(NULL AS VARCHAR) AS category
FROM pf
WHERE p_size NOT IN (1, 2, 50)
  AND {NOT_NULL(['total_fat', 'sugar', 'protein', 'calcium', 'fiber'])}"""


FACTS = """
facts AS (SELECT p.p_brand AS restaurant, p.p_name AS item, l.l_extendedprice AS calories,
                 l.l_quantity AS total_carb, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
          FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def _max_cal_facts(listed: bool) -> str:
    where = f"WHERE restaurant IN ({IN_LIST})" if listed else ""
    return f"""WITH {FACTS}
SELECT restaurant, item, max_calories, {_r('avg_carbohydrates')} AS avg_carbohydrates FROM (
  SELECT restaurant, item, calories AS max_calories,
         avg(total_carb) OVER (PARTITION BY restaurant) AS avg_carbohydrates,
         row_number() OVER (PARTITION BY restaurant
                            ORDER BY calories DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM facts {where})
WHERE rn = 1"""


def _top_facts(listed: bool) -> str:
    where = f"WHERE restaurant IN ({IN_LIST})" if listed else ""
    return f"""WITH {FACTS}
SELECT restaurant, item, max_calories, rank,
       item || '<br>' || 'Calories: ' ||
         CASE WHEN max_calories = floor(max_calories) THEN CAST(CAST(max_calories AS BIGINT) AS VARCHAR)
              ELSE CAST(max_calories AS VARCHAR) END AS label
FROM (SELECT restaurant, item, max(calories) AS max_calories,
             row_number() OVER (PARTITION BY restaurant ORDER BY max(calories) DESC, item) AS rank
      FROM facts {where} GROUP BY restaurant, item)
WHERE rank <= 5"""


def queries_sql() -> dict[str, str]:
    zc = ", ".join(f"{_r('z_' + f)} AS z_{f}" for f in FEATURES)
    feats_avg = ", ".join(f"{_r(f'avg({f})', 4)} AS avg_{f}" for f in FEATURES)
    sql = {
        "nutrition_stats": with_base(f"""
SELECT restaurant, {_r('avg(calories)')} AS avg_calories, min(calories) AS min_calories,
       max(calories) AS max_calories, {_r('avg(total_carb)')} AS avg_carbohydrates
FROM items GROUP BY restaurant"""),
        "restaurant_rank": with_base(f"""
SELECT restaurant, {_r('avg_calories')} AS avg_calories, min_calories, max_calories,
       {_r('avg_carbohydrates')} AS avg_carbohydrates,
       CAST(rank() OVER (ORDER BY avg_carbohydrates DESC) AS BIGINT) AS carb_rank
FROM (SELECT restaurant, avg(calories) AS avg_calories, min(calories) AS min_calories,
             max(calories) AS max_calories, avg(total_carb) AS avg_carbohydrates
      FROM items GROUP BY restaurant)"""),
        "max_calorie_items": _max_calorie(False),
        "max_calorie_items_listed": _max_calorie(True),
        "avg_carbs_share": _share(False),
        "avg_carbs_share_listed": _share(True),
        "top5_items_label": with_base(_top_items(False)),
        "top5_items_label_listed": with_base(_top_items(True)),
        "top5_items_rollup": with_base(f"""
SELECT restaurant, label_short, {_r('value')} AS value, level, {_r('value / total')} AS share_of_root
FROM (SELECT restaurant, label_short, sum(max_calories) AS value,
             CAST(GROUPING(restaurant, label_short) AS INTEGER) AS level
      FROM top GROUP BY ROLLUP (restaurant, label_short)),
     (SELECT sum(max_calories) AS total FROM top)""", extra=f",\ntop AS ({_top_items(False)})"),
        "nutrition_stats_facts": f"""WITH {FACTS}
SELECT restaurant, {_r('avg(calories)')} AS avg_calories, min(calories) AS min_calories,
       max(calories) AS max_calories, {_r('avg(total_carb)')} AS avg_carbohydrates
FROM facts GROUP BY restaurant""",
        "top5_items_facts": _top_facts(False),
        "max_calorie_items_facts": _max_cal_facts(False),
        "max_calorie_items_facts_listed": _max_cal_facts(True),
        "top5_items_facts_listed": _top_facts(True),
        "clean_names": with_base(f"SELECT id, item AS raw_item, {clean('item')} AS item FROM raw"),
        "drop_nulls": with_base(f"""
SELECT p_brand AS restaurant, {DIRTY} AS item, p_retailprice AS calories
FROM pf WHERE p_size NOT IN (1, 2, 50)
  AND {NOT_NULL(['total_fat', 'sugar', 'protein', 'calcium', 'fiber'])}"""),
        "coerce_numeric": with_base(f"""
SELECT p_partkey AS id, CASE WHEN p_size = 2 THEN NULL ELSE p_retailprice * 2 END AS sodium,
       CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS vit_c,
       CASE WHEN p_size = 3 THEN NULL ELSE calcium END AS calcium,
       (p_size <> 3 AND {NOT_NULL(['total_fat', 'sugar', 'protein', 'calcium', 'fiber'])}) AS valid_features
FROM pf"""),
        "load_items": with_base(_menu_typed()),
        "csv_roundtrip": with_base(f"""
SELECT p_partkey AS id, p_brand AS restaurant, CASE WHEN p_size = 1 THEN NULL ELSE {DIRTY} END AS item,
       CASE WHEN p_size = 2 THEN NULL ELSE p_retailprice * 2 END AS sodium
FROM pf"""),
        "surrogate_key": """
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem""",
        "translate_lookup": with_base("""
SELECT i.id, i.item, d.item_gr, d.item IS NOT NULL AS in_dictionary
FROM items i LEFT JOIN dct d ON d.item = i.item"""),
        "translate_words": with_base("SELECT item, item_gr FROM fallback"),
        "translate_items": with_base("SELECT id, item, item_gr FROM titems"),
        "write_back": with_base("""
SELECT i.id, i.item, CASE WHEN d.item IS NOT NULL THEN d.item_gr ELSE i.item END AS item_gr
FROM items i LEFT JOIN dct d ON d.item = i.item"""),
        "feature_stats": with_base(f"""
SELECT feature, {_r('mean')} AS mean, {_r('sd')} AS sd FROM (
  {' UNION ALL '.join(f"SELECT '{f}' AS feature, m_{f} AS mean, s_{f} AS sd FROM st" for f in FEATURES)})""",
                                   extra=_z_ctes()),
        "standardize": with_base(f"SELECT id, {zc} FROM z", extra=_z_ctes()),
        "kmeans_fixed_start": with_base("SELECT id, cluster, category FROM categorized",
                                        extra=_z_ctes() + _lloyd_ctes()),
        "category_profile": with_base(f"""
SELECT category, CAST(count(*) AS BIGINT) AS n_items, {feats_avg}
FROM categorized GROUP BY category""", extra=_z_ctes() + _lloyd_ctes()),
        "correlation_matrix": with_base(" UNION ALL ".join(
            f"SELECT '{a}' AS f1, '{b}' AS f2, {_r(f'corr({a}, {b})')} AS corr FROM valid"
            for i, a in enumerate(FEATURES) for b in FEATURES[i:]), extra=_z_ctes()),
        "export_roundtrip": with_base("SELECT item, item_gr, category FROM categorized",
                                      extra=_z_ctes() + _lloyd_ctes()),
        "browse_categories": with_base("""
SELECT item, item_gr, category, (SELECT count(*) FROM categorized) AS n_rows
FROM categorized
ORDER BY category ASC NULLS FIRST, item DESC NULLS LAST, item_gr ASC NULLS FIRST
LIMIT 25 OFFSET 10""", extra=_z_ctes() + _lloyd_ctes()),
        "top5_items_rollup_label": with_base(f"""
SELECT restaurant, label, {_r('value')} AS value, level, {_r('value / total')} AS share_of_root
FROM (SELECT restaurant, label, sum(max_calories) AS value,
             CAST(GROUPING(restaurant, label) AS INTEGER) AS level
      FROM top GROUP BY ROLLUP (restaurant, label)),
     (SELECT sum(max_calories) AS total FROM top)""", extra=f",\ntop AS ({_top_items(False)})"),
        "number_labels": """
SELECT p_partkey AS id, CAST(p_partkey + 10000000.5::DOUBLE AS VARCHAR) AS large,
       rtrim(CAST(p_size * CAST(0.0001 AS DECIMAL(9, 4)) AS VARCHAR), '0') AS small,
       CAST(p_size::HUGEINT * 300000000000000000 AS VARCHAR) AS wide,
       CAST(-p_size::HUGEINT * 100000000000000000000 AS VARCHAR) AS vast, CAST(NULL AS DOUBLE) AS huge
FROM part""",
        "load_line_breaks": with_base(_menu_typed()),
        "kmeans_fixed_names": with_base("""
SELECT id, cluster, CASE cluster WHEN 0 THEN 'Side' WHEN 1 THEN 'Dessert' WHEN 2 THEN 'Main' END AS category
FROM categorized""", extra=_z_ctes() + _lloyd_ctes()),
        "browse_deep": with_base("""
SELECT item, item_gr, category FROM (
  SELECT item, item_gr, category, count(*) OVER () AS n,
         row_number() OVER (ORDER BY item DESC NULLS LAST, category ASC NULLS FIRST, item_gr ASC NULLS FIRST) - 1 AS place
  FROM categorized) WHERE place >= n // 2 AND place < n // 2 + 1000""", extra=_z_ctes() + _lloyd_ctes()),
        "load_by_header": with_base(_menu_typed(vit_a="CAST(NULL AS DOUBLE)")),
        "load_append": with_base(_menu_typed("p_partkey % 2, p_partkey")),
        "translate_hook": with_base("""
SELECT i.id, i.item, CASE WHEN d.item IS NOT NULL THEN d.item_gr ELSE h.item_gr END AS item_gr
FROM items i LEFT JOIN dct d ON d.item = i.item LEFT JOIN hook h ON h.item = i.item""", extra=""",
hook AS (SELECT m.item, coalesce(string_agg(upper(reverse(w.word)), ' ' ORDER BY w.pos), '') AS item_gr
         FROM missing m LEFT JOIN words w ON w.item = m.item GROUP BY m.item)"""),
        "kmeans_categories": with_base("SELECT id, restaurant, item, cluster, category FROM categorized",
                                       extra=_z_ctes() + _lloyd_ctes("md5('0:' || CAST(id AS VARCHAR)), id")),
        "kmeans_invalid_kept": with_base("SELECT id, cluster, category FROM categorized", extra=""",
loose AS (SELECT p_partkey AS id, p_retailprice AS calories, total_fat, sugar, CAST(p_size AS DOUBLE) AS total_carb,
                 protein, CASE WHEN p_size = 3 THEN NULL ELSE calcium END AS calcium, fiber FROM pf)"""
                                         + _z_ctes("loose") + _lloyd_ctes(source="loose")),
        "inertia": with_base(f"""
SELECT round(sum({_dist('z', 'c')}), 4) AS inertia, CAST(count(*) AS BIGINT) AS n_items
FROM z JOIN fin f ON f.id = z.id JOIN cents c ON c.cluster = f.cluster""", extra=_z_ctes() + _lloyd_ctes()),
        "pca_scores": with_base(f"""
SELECT {', '.join(f"round({' + '.join(f'z.z_{f} * v{n}_{i}' for i, f in enumerate(FEATURES))}, 6) AS PC{n}" for n in (1, 2))},
       c.id, c.item, c.item_gr, c.category, c.item || ' | ' || c.item_gr AS label
FROM z JOIN categorized c ON c.id = z.id, axes""", extra=_z_ctes() + _lloyd_ctes() + _pca_ctes()),
        "browse_all": with_base("""
SELECT item, item_gr, category, (SELECT count(*) FROM categorized) AS n_rows
FROM categorized""", extra=_z_ctes() + _lloyd_ctes()),
    }
    return sql
