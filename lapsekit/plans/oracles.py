"""The same queries in DuckDB SQL, written independently of the Spark plans.

Named pieces are collected into a ``WITH`` list per query. Long column lists are
spelled out by small loops; everything else is plain SQL over the test tables.
"""

from __future__ import annotations

from dataclasses import replace

from lapsekit.plans.catalogue import (
    GRAM_FEATURES,
    OLS_FEATURES,
    PRODUCT_LEVELS,
    RULE_DAYS,
    SEED,
)
from lapsekit.plans.features import feature_names
from lapsekit.plans.specs import COUNTED, MEASURES, STANDIN

AS_OF = f"DATE '{STANDIN.as_of.isoformat()}'"
MEASURE_KINDS = {
    "NbrMeals_REG": ("NbrMeals_REG", "DOUBLE"),
    "NbrMealsEXCEP": ("NbrMeals_EXCEP", "INTEGER"),
    "GrossPrice_Formula": ("GrossFormulaPrice", "INTEGER"),
    "NetPrice_Formula": ("NetFormulaPrice", "INTEGER"),
    "Price_per_meal": ("NbrMealsPrice", "DOUBLE"),
    "Discount_Product": ("ProductDiscount", "INTEGER"),
    "Discount_Formula": ("FormulaDiscount", "INTEGER"),
    "Discount_Total": ("TotalDiscount", "INTEGER"),
    "Price_Total": ("TotalPrice", "INTEGER"),
    "Credit_Total": ("TotalCredit", "INTEGER"),
}


def _read(column: str, kind: str) -> str:
    number = f"try_cast({column} AS DOUBLE)"
    return number if kind == "DOUBLE" else f"CAST(trunc({number}) AS INTEGER)"


def _days(end: str, start: str) -> str:
    return f"CAST(date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE)) AS INTEGER)"


def _count(condition: str, name: str) -> str:
    return f'count(*) FILTER (WHERE {condition}) AS "{name}"'


def _profile(measures, counted=COUNTED) -> str:
    parts = []
    for m in measures:
        mean = f"round(avg({m}), 2)"
        if m == "Price_per_meal":  # units of the text's four places, rounded half up by integer division
            units = "sum(CAST(try_cast(PriceText AS DECIMAL(18,4)) * 10000 AS BIGINT))"
            mean = f"CAST((2 * {units} + 100 * count({m})) // (200 * count({m})) AS DOUBLE) / 100"
        top, low = (f"round({f}({m}), 2)" for f in ("max", "min"))
        if m == "Price_per_meal":
            top, low = (f"CAST(round({f}(try_cast(PriceText AS DECIMAL(18,4))), 2) AS DOUBLE)" for f in ("max", "min"))
        parts += [f"{mean} AS avg_{m}", f"{top} AS max_{m}", f"{low} AS min_{m}"]
        if m in counted:
            parts.append(f"count({m}) AS count_{m}")
    return ", ".join(parts)


def _case_counts(counts) -> list[str]:
    return [_count(f"{col} = '{value}'", name) for col, names in counts.items() for value, name in names.items()]


# The categories that the spec leaves to be found in the tables.
LISTED = replace(
    STANDIN,
    categories="listed",
    complaint_counts={
        col: {**names, **({"sign.up": "ComplaintTypeDesc_sign_up", "view": "ComplaintTypeDesc_view"} if col == "ComplaintTypeDesc" else {})}
        for col, names in STANDIN.complaint_counts.items()
    },
    delivery_counts={
        col: {**names, **({"R": "DeliveryTypeName_R"} if col == "DeliveryTypeName" else {})}
        for col, names in STANDIN.delivery_counts.items()
    },
)
FOUND = ("ComplaintTypeDesc_sign_up", "ComplaintTypeDesc_view")
COMPLAINT_NAMES = [n for names in LISTED.complaint_counts.values() for n in names.values()]
YEAR_COUNTS = [_count(f"year(StartDate) = {y}", f"Sub_{y}") for y in STANDIN.years]
YEAR_TOTAL = _count(f"year(StartDate) IN ({', '.join(map(str, STANDIN.years))})", "TotalSubscriptions")
FORMULA_COUNTS = [_count(f"FormulaType = '{t}'", t) for t in STANDIN.formula_types]
FEATURES = feature_names(LISTED)
NUMERIC = [f for f in FEATURES if f not in ("CustomerID", "label", "Region_Cust")]

TENURE = f"""CAST(sum({_days('EndDate', 'StartDate')}) AS BIGINT) AS AggSubscriptionDuration,
  min({_days(AS_OF, 'Date_Payment')}) AS NbDayLastPayment,
  min({_days(AS_OF, 'Date_Renewal')}) AS NbDayLastRenewal"""

PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """SELECT l_orderkey, min(l_partkey) AS part, CAST(sum(l_quantity) AS BIGINT) AS quantity,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross,
  sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net,
  min(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS cheapest,
  CAST(round(min(l_discount) * 100) AS INTEGER) AS least_off,
  CAST(round(max(l_discount) * 100) AS INTEGER) AS most_off,
  CAST(round(max(l_tax) * 100) AS INTEGER) AS tax,
  sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS returned
FROM lineitem GROUP BY l_orderkey""",
    ),
    "subs": (
        ("lines",),
        """SELECT o_custkey AS CustomerID, o_orderkey AS SubscriptionID, CAST(o_orderdate AS DATE) AS StartDate,
  CASE WHEN l_orderkey IS NOT NULL THEN CAST(o_orderdate AS DATE) + 30 END AS EndDate,
  CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS RenewalDate,
  CASE WHEN o_orderstatus = 'O' THEN 'NA' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS PaymentDate,
  part AS FormulaID, o_orderpriority AS ProductName,
  coalesce(CAST(quantity AS VARCHAR), 'NA') AS NbrMeals_REG,
  CASE WHEN o_orderstatus = 'O' THEN 'NA'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS NbrMeals_EXCEP,
  coalesce(CAST(CAST(gross AS DECIMAL(18,2)) AS VARCHAR), 'NA') AS GrossFormulaPrice,
  coalesce(CAST(CAST(net AS DECIMAL(18,2)) AS VARCHAR), 'NA') AS NetFormulaPrice,
  coalesce(CAST(CAST(cheapest AS DECIMAL(18,4)) AS VARCHAR), 'NA') AS NbrMealsPrice,
  coalesce(CAST(least_off AS VARCHAR), 'NA') AS ProductDiscount,
  coalesce(CAST(tax AS VARCHAR), 'NA') AS FormulaDiscount,
  coalesce(CAST(most_off AS VARCHAR), 'NA') AS TotalDiscount,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS TotalPrice,
  coalesce(CAST(CAST(returned AS DECIMAL(18,2)) AS VARCHAR), 'NA') AS TotalCredit
FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey""",
    ),
    "typed": (
        ("subs",),
        "SELECT *, "
        + ", ".join(f"{_read(raw, kind)} AS t_{name}" for name, (raw, kind) in MEASURE_KINDS.items())
        + ", try_cast(RenewalDate AS TIMESTAMP) AS Date_Renewal, try_cast(PaymentDate AS TIMESTAMP) AS Date_Payment"
        + " FROM subs",
    ),
    "measures": (
        ("typed",),
        "SELECT CustomerID, StartDate, EndDate, ProductName, FormulaID, Date_Renewal, Date_Payment, NbrMealsPrice AS PriceText, "
        + ", ".join(f"CAST(t_{name} AS DOUBLE) AS {name}" for name in MEASURE_KINDS)
        + " FROM typed",
    ),
    "latest": (
        ("subs",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID
  ORDER BY EndDate DESC NULLS LAST, SubscriptionID DESC) AS rn FROM subs) WHERE rn = 1""",
    ),
    "labels": (
        ("latest",),
        f"""SELECT CustomerID, CASE WHEN EndDate IS NOT NULL AND RenewalDate = 'NA'
  AND year(EndDate) <> {STANDIN.current_year} THEN 1 ELSE 0 END AS label FROM latest""",
    ),
    "complaints": (
        (),
        """SELECT event_id AS ComplaintID, user_id AS CustomerID, CAST(ts AS DATE) AS ComplaintDate,
  CASE k % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'plus' WHEN 2 THEN 'family' WHEN 3 THEN 'event'
    ELSE 'NA' END AS ProductName,
  CASE WHEN k % 20 = 7 THEN 'NA' WHEN event_type = 'error' THEN 'other'
    WHEN event_type = 'signup' THEN 'sign.up' ELSE event_type END AS ComplaintTypeDesc,
  CASE WHEN k < 25 THEN 'discount' WHEN k < 50 THEN 'free service' WHEN k < 70 THEN 'no compensation'
    WHEN k < 85 THEN 'other' ELSE 'NA' END AS SolutionTypeDesc,
  CASE WHEN value < 10 THEN 'satisfied' WHEN value < 30 THEN 'not satisfied' WHEN value < 60 THEN 'no response'
    WHEN value < 100 THEN 'other' ELSE 'NA' END AS FeedbackTypeDesc
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    ),
    "recoded": (
        ("complaints",),
        """SELECT ComplaintID, CustomerID, ComplaintDate,
  CASE ProductName WHEN 'NA' THEN 'Other_Product' ELSE ProductName END AS ProductName,
  CASE ComplaintTypeDesc WHEN 'other' THEN 'Diff_Complaint' WHEN 'NA' THEN 'Other_Complaint'
    ELSE ComplaintTypeDesc END AS ComplaintTypeDesc,
  CASE WHEN SolutionTypeDesc IN ('NA', 'other') THEN 'Solution_Other' ELSE SolutionTypeDesc END AS SolutionTypeDesc,
  CASE FeedbackTypeDesc WHEN 'NA' THEN 'No_Feedback' ELSE FeedbackTypeDesc END AS FeedbackTypeDesc
FROM complaints""",
    ),
    "customers": (
        (),
        "SELECT c_custkey AS CustomerID, n_regionkey AS Region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    ),
    "owners": ((), "SELECT o_orderkey AS SubscriptionID, o_custkey AS CustomerID FROM orders"),
    "delivery": (
        (),
        """SELECT l_orderkey AS SubscriptionID, l_linestatus AS DeliveryClass,
  nullif(l_returnflag, 'N') AS DeliveryTypeName, CAST(l_shipdate AS DATE) AS DeliveryDate FROM lineitem""",
    ),
    "formula": ((), "SELECT p_partkey AS FormulaID, p_type AS FormulaType FROM part"),
    "complaint_part": (
        ("recoded",),
        "SELECT CustomerID, "
        + ", ".join(_case_counts(LISTED.complaint_counts))
        + f", {_days(AS_OF, 'max(ComplaintDate)')} AS NbDayLastComplaint, count(*) AS n_complaints"
        + " FROM recoded GROUP BY CustomerID",
    ),
    "complaint_block": (
        ("complaint_part",),
        "SELECT *, "
        + " + ".join(n for n in COMPLAINT_NAMES if n not in ("Other_Complaint", *FOUND))
        + " AS NbrTotalComplaints FROM complaint_part",
    ),
    "delivery_block": (
        ("delivery", "owners"),
        "SELECT CustomerID, "
        + ", ".join(_case_counts(LISTED.delivery_counts))
        + f", {_days(AS_OF, 'max(DeliveryDate)')} AS NbDayLastDelivery"
        + " FROM delivery JOIN owners USING (SubscriptionID) GROUP BY CustomerID",
    ),
    "formula_block": (
        ("subs", "formula"),
        f"SELECT CustomerID, {', '.join(FORMULA_COUNTS)} FROM subs LEFT JOIN formula USING (FormulaID) GROUP BY CustomerID",
    ),
    "profile": (("measures",), f"SELECT CustomerID, {_profile(MEASURE_KINDS)} FROM measures GROUP BY CustomerID"),
    "tenure": (("measures",), f"SELECT CustomerID, {TENURE} FROM measures GROUP BY CustomerID"),
    "products": (
        ("subs",),
        "SELECT CustomerID, "
        + ", ".join(_count(f"ProductName = '{p}'", n) for p, n in STANDIN.products.items())
        + " FROM subs GROUP BY CustomerID",
    ),
    "frequency": (("subs",), f"SELECT CustomerID, {', '.join(YEAR_COUNTS)}, {YEAR_TOTAL} FROM subs GROUP BY CustomerID"),
    "subscription_block": (
        ("profile", "tenure", "products", "frequency", "labels"),
        """SELECT * FROM products JOIN profile USING (CustomerID) JOIN tenure USING (CustomerID)
  JOIN frequency USING (CustomerID) JOIN labels USING (CustomerID)""",
    ),
    "features": (
        ("subscription_block", "customers", "complaint_block", "delivery_block", "formula_block"),
        "SELECT CustomerID, 'Region' || CAST(Region AS VARCHAR) AS Region_Cust, label, "
        + ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in NUMERIC)
        + """ FROM subscription_block LEFT JOIN customers USING (CustomerID) LEFT JOIN complaint_block USING (CustomerID)
  LEFT JOIN delivery_block USING (CustomerID) LEFT JOIN formula_block USING (CustomerID)""",
    ),
    "rule": (
        ("subscription_block",),
        f"""SELECT CustomerID, label, CASE WHEN coalesce(NbDayLastRenewal, 0) > {RULE_DAYS} THEN 1.0 ELSE 0.0
  END::DOUBLE AS prediction FROM subscription_block""",
    ),
    "cells": (
        ("rule",),
        f"""SELECT {_count('prediction = 1 AND label = 1', 'tp')}, {_count('prediction = 1 AND label = 0', 'fp')},
  {_count('prediction = 0 AND label = 1', 'fn')}, {_count('prediction = 0 AND label = 0', 'tn')} FROM rule""",
    ),
    "train": (
        ("features",),
        f"SELECT * FROM features WHERE CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#{SEED}'), 1, 8) AS BIGINT) % 10000 < 7000",
    ),
    "long_train": (
        ("train",),
        "UNPIVOT (SELECT CustomerID, "
        + ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in NUMERIC)
        + " FROM train) ON "
        + ", ".join(f'"{n}"' for n in NUMERIC)
        + " INTO NAME feature VALUE v",
    ),
    "positions": (
        (),
        "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NUMERIC)) + ") AS t(i, feature)",
    ),
    "placed": (("long_train", "positions"), "SELECT CustomerID, CAST(i AS INTEGER) AS i, feature, v FROM long_train JOIN positions USING (feature)"),
    "pairs": (
        ("placed",),
        """SELECT a.i AS i, b.i AS j, a.feature AS col_i, b.feature AS col_j,
  CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END AS r
FROM placed a JOIN placed b ON a.CustomerID = b.CustomerID AND a.i < b.i GROUP BY ALL""",
    ),
    "long_features": (
        ("features",),
        "UNPIVOT (SELECT label AS class, "
        + ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in NUMERIC)
        + " FROM features) ON "
        + ", ".join(f'"{n}"' for n in NUMERIC)
        + " INTO NAME feature VALUE v",
    ),
    "spans": (("long_features",), "SELECT feature, min(v) AS lo, max(v) AS hi FROM long_features GROUP BY feature"),
}


def _with(body: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in PIECES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    listed = ",\n".join(f"{n} AS ({PIECES[n][1]})" for n in order)
    return f"WITH {listed}\n{body}" if order else body


def _quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _ols_sql() -> str:
    """Three-variable least squares by cofactors of the 3 x 3 Gram matrix.

    The p-value integrates the t density from 0 to |t| by Simpson's rule.
    """
    a, b, c = (f"CAST({n} AS DOUBLE)" for n in OLS_FEATURES)
    y = "CAST(label AS DOUBLE)"
    sums = ", ".join(
        f"sum({p} * {q}) AS {name}"
        for name, p, q in [
            ("aa", a, a), ("ab", a, b), ("ac", a, c), ("bb", b, b), ("bc", b, c), ("cc", c, c),
            ("ay", a, y), ("by", b, y), ("cy", c, y), ("yy", y, y),
        ]
    )
    body = f"""SELECT feature, round(beta, 10) AS coefficient, round(sqrt(s2 * v), 10) AS std_error,
  round(beta / sqrt(s2 * v), 6) AS t_value,
  (SELECT round(greatest(1 - 2 * (top / 3000) * sum(
      CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
      * exp(lgamma((n - 2) / 2) - lgamma((n - 3) / 2) - 0.5 * ln((n - 3) * pi())
            - (n - 2) / 2 * ln(1 + pow(k * top / 1000, 2) / (n - 3)))), 0), 6)
   FROM (SELECT least(abs(beta / sqrt(s2 * v)), 12) AS top), range(1001) AS g(k) GROUP BY top) AS p_value FROM (
  SELECT *, (yy - ba * ay - bb_ * "by" - bc_ * cy) / (n - 3) AS s2 FROM (
    SELECT *, iaa * ay + iab * "by" + iac * cy AS ba, iab * ay + ibb * "by" + ibc * cy AS bb_,
      iac * ay + ibc * "by" + icc * cy AS bc_ FROM (
      SELECT *, (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac,
        (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM (
        SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det
        FROM (SELECT count(*) AS n, {sums.replace(' AS by', ' AS "by"')} FROM train)))))
  CROSS JOIN LATERAL (VALUES ('{OLS_FEATURES[0]}', ba, iaa), ('{OLS_FEATURES[1]}', bb_, ibb),
    ('{OLS_FEATURES[2]}', bc_, icc)) AS t(feature, beta, v)"""
    return _with(body, "train")


def _gram_sql() -> str:
    names = [*GRAM_FEATURES, "label"]
    rows = ", ".join(
        f"('{p}', '{q}', (SELECT round(sum(CAST(\"{p}\" AS DOUBLE) * \"{q}\"), 2) FROM train))"
        for i, p in enumerate(names)
        for q in names[i:]
    )
    return _with(f"SELECT * FROM (VALUES {rows}) AS t(col_i, col_j, s)", "train")


def _rates() -> str:
    precision = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END"
    recall = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END"
    body = f"""SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy,
  round(p, 9) AS "precision", round(r, 9) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 5 * p * r / (4 * p + r) END, 9) AS f_beta,
  round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 9) AS auc_hard
FROM (SELECT *, ({precision})::DOUBLE AS p, ({recall})::DOUBLE AS r FROM cells)"""
    return _with(body, "cells")


def _curves_sql(points: int = 50, fine: int = 10) -> str:
    cells = (points - 1) * fine + 1
    body = f"""SELECT feature, class, CAST(point AS INTEGER) AS point, round(lo + point * ((hi - lo) / {points - 1}), 6) AS x,
  round(sum(here * exp(-0.5 * pow((point * {fine} - cell) * step / h, 2))
    + above * exp(-0.5 * pow((point * {fine} - cell - 1) * step / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM (SELECT feature, class, cell, step, lo, hi, sum(1 - (place - cell)) AS here, sum(place - cell) AS above
  FROM (SELECT *, least(floor(place), {cells - 2}) AS cell FROM
    (SELECT *, (v - lo) / step AS place FROM
      (SELECT *, (hi - lo) / {cells - 1} AS step FROM long_features JOIN spans USING (feature) WHERE hi > lo))) GROUP BY ALL)
JOIN (SELECT feature, class, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h
      FROM long_features GROUP BY feature, class HAVING stddev_samp(v) > 0) USING (feature, class)
CROSS JOIN range({points}) AS g(point) GROUP BY feature, class, point, lo, hi"""
    return _with(body, "long_features", "spans")


def _auc_sql() -> str:
    """Area under the curve of each feature as a score, by the mean rank of the churners."""
    body = """SELECT feature, round((sum(rank) FILTER (WHERE class = 1) - p * (p + 1) / 2) / (p * (any_value(n) - p)), 9) AS auc_score
FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rank,
        count(*) OVER (PARTITION BY feature) AS n, CAST(count(*) FILTER (WHERE class = 1) OVER (PARTITION BY feature) AS DOUBLE) AS p
      FROM long_features) GROUP BY feature, p"""
    return _with(body, "long_features")


def _vectors_sql() -> str:
    """Dummies of all but the rarest region, then the columns in units of their deviation on the training side."""
    ranks = """SELECT Region_Cust, row_number() OVER (ORDER BY n DESC, Region_Cust) - 1 AS rank, count(*) OVER () AS k
  FROM (SELECT Region_Cust, count(*) AS n FROM train WHERE Region_Cust IS NOT NULL GROUP BY 1)"""
    scaled = "\nUNION ALL ".join(
        f"""SELECT CustomerID, k - 1 + {i} AS position, coalesce("{c}" / nullif((SELECT stddev_samp("{c}") FROM train), 0), 0.0) AS value
  FROM features JOIN ranks USING (Region_Cust)""" for i, c in enumerate(OLS_FEATURES)
    )
    body = f"""SELECT CustomerID, CAST(position AS INTEGER) AS position, round(value, 6) AS value FROM (
  SELECT CustomerID, place AS position, CASE WHEN rank = place THEN 1.0 ELSE 0.0 END::DOUBLE AS value
  FROM features JOIN ranks USING (Region_Cust), LATERAL (SELECT unnest(range(k - 1)) AS place)
UNION ALL {scaled})"""
    return _with(body, "train").replace("\nSELECT CustomerID, CAST(position", f",\nranks AS ({ranks})\nSELECT CustomerID, CAST(position", 1)


def _corr_sql() -> str:
    names = GRAM_FEATURES
    rows = ", ".join(
        f"({i}, {j}, '{names[i]}', '{names[j]}', (SELECT CASE WHEN min(\"{names[i]}\") < max(\"{names[i]}\") AND min(\"{names[j]}\") < max(\"{names[j]}\") THEN round(corr(\"{names[i]}\", \"{names[j]}\"), 6) END FROM features))"
        for i in range(len(names))
        for j in range(i + 1, len(names))
    )
    return _with(f"SELECT * FROM (VALUES {rows}) AS t(i, j, col_i, col_j, r)", "features")


def _density_sql(bins: int = 20) -> str:
    body = f"""SELECT feature, class, bin, round(lo + bin * w, 6) AS bin_start, n,
  round(n / (sum(n) OVER (PARTITION BY feature, class) * w), 10) AS density
FROM (SELECT feature, class, lo, w, CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM (SELECT *, (hi - lo) / {bins} AS w FROM long_features JOIN spans USING (feature)) GROUP BY ALL)"""
    return _with(body, "long_features", "spans")


def _build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["scan_subscriptions"] = _with("SELECT * FROM subs", "subs")
    sql["view_sql"] = _with(
        """SELECT ProductName, count(*) AS n_rows, count(EndDate) AS n_ended, max(StartDate) AS last_start
FROM subs WHERE RenewalDate <> 'NA' GROUP BY ProductName""",
        "subs",
    )
    tables = {
        "subscriptions": "orders", "owners": "orders", "complaints": "events",
        "customers": "customer", "delivery": "lineitem", "formula": "part",
    }
    sql["row_counts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {table}" for name, table in tables.items()
    )
    sql["project_cols"] = _with(
        "SELECT CustomerID, StartDate, EndDate, RenewalDate, CAST(year(EndDate) AS INTEGER) AS Year_EndDate FROM subs", "subs"
    )
    sql["rename_map"] = _with(
        "SELECT CustomerID, SubscriptionID, ProductName AS Product, TotalPrice AS Price_Text FROM subs", "subs"
    )
    sql["recode_sentinel"] = _with("SELECT * FROM recoded", "recoded")
    sql["typed_cast"] = _with(
        "SELECT SubscriptionID, " + ", ".join(f"t_{n} AS {n}" for n in MEASURE_KINDS) + ", Date_Renewal, Date_Payment FROM typed",
        "typed",
    )
    sql["fill_measure_zero"] = _with(
        "SELECT SubscriptionID, "
        + ", ".join(
            f"coalesce(try_cast({c} AS DOUBLE), 0.0) AS {c}"
            for c in MEASURES
        )
        + " FROM subs",
        "subs",
    )
    sql["date_fallback"] = _with(
        """SELECT SubscriptionID, coalesce(try_cast(PaymentDate AS DATE), EndDate) AS Date_Payment,
  coalesce(try_cast(RenewalDate AS DATE), EndDate) AS Date_Renewal FROM subs""",
        "subs",
    )
    sql["parse_date"] = """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'O' THEN 'NA' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS text,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders"""
    sql["days_between"] = _with(
        f"""SELECT SubscriptionID, {_days('EndDate', 'StartDate')} AS days_running,
  {_days(AS_OF, 'EndDate')} AS days_since_end FROM subs""",
        "subs",
    )
    sql["churn_label"] = _with("SELECT CustomerID, label FROM labels", "labels")
    sql["region_tag"] = _with("SELECT CustomerID, 'Region' || CAST(Region AS VARCHAR) AS Region_Cust FROM customers", "customers")
    summed = ["Discount_Product", "Discount_Formula", "Discount_Total", "NbrMealsEXCEP"]
    sql["row_sum"] = _with(
        "SELECT SubscriptionID, CAST(" + " + ".join(f"coalesce(t_{c}, 0)" for c in summed) + " AS BIGINT) AS total FROM typed",
        "typed",
    )
    numbers = [*COMPLAINT_NAMES, "NbrTotalComplaints", "NbDayLastComplaint"]
    sql["na_fill"] = _with(
        "SELECT CustomerID, "
        + ", ".join(f"coalesce({n}, 0) AS {n}" for n in numbers)
        + " FROM customers LEFT JOIN complaint_block USING (CustomerID)",
        "customers", "complaint_block",
    )
    sql["one_hot"] = (
        "SELECT o_orderkey AS SubscriptionID, o_orderpriority AS ProductName, "
        + ", ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"ProductName_{p}\"" for p in PRODUCT_LEVELS)
        + " FROM orders"
    )
    sql["one_hot_found"] = (
        "SELECT p_partkey AS FormulaID, p_type AS FormulaType, "
        + ", ".join(f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS type_{t}" for t in STANDIN.formula_types)
        + " FROM part"
    )
    sql["distinct_categories"] = _with("SELECT DISTINCT DeliveryTypeName FROM delivery", "delivery")
    sql["union_all"] = _with(
        """SELECT CustomerID, StartDate AS day, 'start' AS kind FROM subs
UNION ALL SELECT CustomerID, ComplaintDate, 'complaint' FROM complaints""",
        "subs", "complaints",
    )
    sql["latest_per_key"] = _with(
        """SELECT CustomerID, CASE WHEN EndDate IS NOT NULL THEN SubscriptionID END AS SubscriptionID,
  CASE WHEN EndDate IS NOT NULL THEN StartDate END AS StartDate, EndDate,
  CASE WHEN EndDate IS NOT NULL THEN RenewalDate END AS RenewalDate FROM latest""",
        "latest",
    )
    sql["dedup_key"] = """SELECT o_custkey AS CustomerID, o_orderkey AS SubscriptionID, CAST(o_orderdate AS DATE) AS StartDate,
  o_orderpriority AS ProductName FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
    sql["feature_inner"] = _with(
        """SELECT CustomerID, 'Region' || CAST(Region AS VARCHAR) AS Region_Cust, NbrTotalComplaints
FROM complaint_block JOIN customers USING (CustomerID)""",
        "complaint_block", "customers",
    )
    sql["fact_to_owner"] = _with("SELECT * FROM delivery LEFT JOIN owners USING (SubscriptionID)", "delivery", "owners")
    lookup = _with(
        "SELECT CustomerID, SubscriptionID, FormulaID, FormulaType FROM subs LEFT JOIN formula USING (FormulaID)", "subs", "formula"
    )
    sql["dim_lookup"] = lookup
    sql["dim_lookup_shuffled"] = lookup
    sql["last_date"] = _with("SELECT CustomerID, max(ComplaintDate) AS last_complaint FROM complaints GROUP BY CustomerID", "complaints")
    sql["label_distribution"] = _with('SELECT label, count(*) AS "count" FROM labels GROUP BY label', "labels")
    sql["count_two_keys"] = (
        'SELECT o_custkey AS CustomerID, CAST(year(o_orderdate) AS INTEGER) AS "year", count(*) AS "count" FROM orders GROUP BY 1, 2'
    )
    sql["measure_profile"] = _with("SELECT * FROM profile", "profile")
    zeroed = list(MEASURE_KINDS)
    sql["measure_profile_zero"] = _with(
        f"SELECT CustomerID, {_profile(zeroed, zeroed)} FROM (SELECT CustomerID, "
        + ", ".join(f"coalesce({m}, 0.0) AS {m}" for m in zeroed)
        + ", CASE WHEN Price_per_meal IS NULL THEN '0' ELSE PriceText END AS PriceText FROM measures) GROUP BY CustomerID",
        "measures",
    )
    sql["recency_duration"] = _with(
        f"SELECT CustomerID, {TENURE}, {_days('max(EndDate)', 'min(StartDate)')} AS SpanDays FROM measures GROUP BY CustomerID",
        "measures",
    )
    sql["category_counts"] = _with("SELECT * FROM products", "products")
    dummies = {
        "class_F": "l_linestatus = 'F'", "class_O": "l_linestatus = 'O'",
        "type_A": "l_returnflag = 'A'", "type_R": "l_returnflag = 'R'", "type_null": "l_returnflag = 'N'",
    }
    sql["sum_all_numeric"] = (
        "SELECT l_orderkey AS SubscriptionID, "
        + ", ".join(_count(cond, f"sum_{name}") for name, cond in dummies.items())
        + " FROM lineitem GROUP BY l_orderkey"
    )
    sql["pivot_year"] = (
        "SELECT o_custkey AS CustomerID, "
        + ", ".join(_count(f"year(o_orderdate) = {y}", f"y{y}") for y in (*STANDIN.years, 2002))
        + " FROM orders GROUP BY o_custkey"
    )
    sql["pivot_formula"] = _with(
        f"SELECT CustomerID, {', '.join(FORMULA_COUNTS)}, {_count('FormulaType IS NULL', 'null')} "
        "FROM subs LEFT JOIN formula USING (FormulaID) GROUP BY CustomerID",
        "subs", "formula",
    )
    sql["yearly_frequency"] = _with("SELECT * FROM frequency", "frequency")
    sql["subscription_block"] = _with("SELECT * FROM subscription_block", "subscription_block")
    sql["complaint_block"] = _with("SELECT * FROM complaint_block", "complaint_block")
    declared = ["ComplaintTypeDesc_undeclared", "ProductName_undeclared", "SolutionTypeDesc_undeclared", "FeedbackTypeDesc_undeclared"]
    sql["complaint_block_declared"] = _with(
        f"SELECT * EXCLUDE ({', '.join(FOUND)}, n_complaints), {' + '.join(FOUND)} AS {declared[0]}, "
        + ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in declared[1:])
        + " FROM complaint_block",
        "complaint_block",
    )
    sql["recency_slashed"] = sql["recency_duration"]
    sql["customer_block"] = sql["region_tag"]
    sql["delivery_block"] = _with("SELECT * FROM delivery_block", "delivery_block")
    sql["formula_block"] = _with("SELECT * FROM formula_block", "formula_block")
    sql["feature_table"] = _with(f"SELECT {_quoted(FEATURES)} FROM features", "features")
    sql["rule_predictions"] = _with("SELECT * FROM rule", "rule")
    sql["filter_pred"] = _with("SELECT * FROM rule WHERE prediction = 1 AND label = 0", "rule")
    sql["confusion_metrics"] = _rates()
    sql["auc_hard"] = _with("SELECT round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 9) AS auc_hard FROM cells", "cells")
    side = f"CASE WHEN CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#{SEED}'), 1, 8) AS BIGINT) % 10000 < 7000 THEN 'train' ELSE 'test' END AS side"
    sql["split_members"] = _with(f"SELECT CustomerID, {side} FROM customers", "customers")
    slot = f"CAST('0x' || substr(md5(CAST(CustomerID AS VARCHAR) || '#{SEED}'), 1, 8) AS BIGINT) % 10000"
    sql["fold_members"] = _with(f"SELECT CustomerID, CAST({slot} % 3 AS INTEGER) AS fold FROM customers", "customers")
    sql["skipped_customers"] = _with(
        "SELECT count(*) FILTER (WHERE Region_Cust IS NULL) AS n_skipped, count(*) AS n_customers FROM features", "features"
    )
    sql["model_row_totals"] = _with(
        f"""SELECT model, split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_churned
FROM (SELECT {side.replace('AS side', 'AS split')}, label FROM features WHERE Region_Cust IS NOT NULL),
  (VALUES ('logistic_regression'), ('decision_tree'), ('random_forest')) AS m(model) GROUP BY model, split""",
        "features",
    )
    sql["tuned_row_totals"] = _with(
        f"""SELECT {side.replace('AS side', 'AS split')}, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_churned
FROM features WHERE Region_Cust IS NOT NULL GROUP BY 1""",
        "features",
    )
    sql["score_totals"] = _with(
        "SELECT count(Region_Cust) AS n_scored, count(*) - count(Region_Cust) AS n_unscored, CAST(0 AS BIGINT) AS n_invalid FROM features",
        "features",
    )
    sql["scored_flags"] = _with(f"SELECT {_quoted(FEATURES)}, Region_Cust IS NOT NULL AS has_score FROM features", "features")
    sql["split_counts"] = _with(f'SELECT {side}, label, count(*) AS "count" FROM labels GROUP BY 1, 2', "labels")
    sql["corr_matrix"] = _with("SELECT i, j, col_i, col_j, round(r, 6) AS r FROM pairs", "pairs")
    sql["corr_prune"] = _with(
        """SELECT CAST(i AS INTEGER) AS position, feature,
  i NOT IN (SELECT j FROM pairs WHERE r >= 0.9) AS kept FROM positions""",
        "pairs", "positions",
    )
    sql["gram_matrix"] = _gram_sql()
    sql["ols_coefficients"] = _ols_sql()
    sql["rank_sum_auc"] = _auc_sql()
    sql["assembled_vectors"] = _vectors_sql()
    sql["corr_given"] = _corr_sql()
    sql["region_model"] = _with(
        "SELECT Region_Cust, round(avg(label), 3) AS churn_rate FROM train WHERE Region_Cust IS NOT NULL GROUP BY 1", "train"
    )
    sql["feature_counts"] = _with(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE CustomerID IS NULL) AS n_null_keys,
  count(*) FILTER (WHERE label = 1) AS n_positive FROM features""",
        "features",
    )
    sql["class_density"] = _density_sql()
    sql["class_density_curves"] = _curves_sql()
    sql["string_index"] = _with(
        """SELECT CustomerID, Region_Cust, CAST(rank AS DOUBLE) AS Region_idx FROM
  (SELECT CustomerID, 'Region' || CAST(Region AS VARCHAR) AS Region_Cust FROM customers WHERE Region IS NOT NULL)
  JOIN (SELECT Region_Cust, row_number() OVER (ORDER BY n DESC, Region_Cust) - 1 AS rank FROM
    (SELECT 'Region' || CAST(Region AS VARCHAR) AS Region_Cust, count(*) AS n FROM customers WHERE Region IS NOT NULL GROUP BY 1))
  USING (Region_Cust)""",
        "customers",
    )
    sql["scale_unit_std"] = _with(
        "SELECT CustomerID, "
        + ", ".join(f'coalesce(round("{c}" / nullif(s_{i}, 0), 6), 0.0) AS "{c}"' for i, c in enumerate(NUMERIC))
        + " FROM features CROSS JOIN (SELECT "
        + ", ".join(f'stddev_samp("{c}") AS s_{i}' for i, c in enumerate(NUMERIC))
        + " FROM features)",
        "features",
    )
    return sql


ORACLES = _build()
