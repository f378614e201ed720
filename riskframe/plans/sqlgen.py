"""DuckDB text of the loan pipeline, generated from the same constants as the
Spark plans. Used only as the correctness oracle (``oracle_sql``)."""

from __future__ import annotations

from ..sources import loans as L
from . import loanprep as P


def q(name: str) -> str:
    """Quoted identifier."""
    return '"' + name.replace('"', '""') + '"'


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def recode_sql(col: str, mapping: dict, passthrough: bool = True) -> str:
    whens = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {col if passthrough else 'NULL'} END)"


def null_count_sql(cols: list[str]) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in cols)


def hash_rank_sql(seed, key: str = "loan_id", part: str = "y") -> str:
    return (f"row_number() OVER (PARTITION BY {part} ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key})")


def round_half_up_sql(x: str) -> str:
    return f"floor({x} + 0.5)"


def cleaned_ctes() -> str:
    """CTEs ``view``, ``lk``, ``b1``, ``cleaned``."""
    label = recode_sql("loan_status", L.VIEW_STATUS_CLASSES, passthrough=False)
    purpose = recode_sql("purpose", L.VIEW_PURPOSE_RECODE)
    sent = {c: f"(CASE WHEN {c} = {lit(v)} THEN {lit(r)} ELSE {c} END)" for c, (v, r) in L.VIEW_SENTINELS.items()}
    clamp = {c: f"(CASE WHEN {c} < {lit(b)} THEN {lit(b)} ELSE {c} END)" for c, b in L.VIEW_LOWER_CLAMPS.items()}

    def col(c):
        return sent.get(c) or clamp.get(c) or c
    return f"""
view AS ({L.LOAN_VIEW_SQL}),
lk AS (SELECT n.n_name AS code, r.r_name AS grp FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
b1 AS (SELECT * FROM view WHERE {null_count_sql(L.VIEW_COLUMNS)} <= {P.max_nulls()}),
cleaned AS (
  SELECT loan_id, CAST({label} AS INTEGER) AS y, sub_grade, {purpose} AS purpose, initial_list_status,
         coalesce(lk.grp, b1.addr_state) AS addr_state, installment, {col('revol_bal')} AS revol_bal,
         emp_length, {col('dti')} AS dti, int_rate,
         TRY_CAST(NULLIF(regexp_extract(sub_grade, '(\\d+)', 1), '') AS INTEGER) AS term
  FROM b1 LEFT JOIN lk ON b1.addr_state = lk.code
  WHERE {label} IS NOT NULL AND {purpose} IS DISTINCT FROM {lit(L.VIEW_DROP_PURPOSE)}
)"""


CLEAN_COLS = ["loan_id", "y", "sub_grade", "purpose", "initial_list_status", "addr_state", "installment",
              "revol_bal", "emp_length", "dti", "int_rate", "term"]


def split_ctes() -> str:
    """adds ``sampled`` (C1) and ``splitted``."""
    cols = ", ".join(CLEAN_COLS)
    share = lit(float(L.VIEW_REMOVE_SHARE_CLASS1))
    tf = lit(float(L.VIEW_TEST_FRACTION))
    return cleaned_ctes() + f""",
ds_rank AS (SELECT *, {hash_rank_sql(P.DOWNSAMPLE_SEED)} AS rk, count(*) OVER (PARTITION BY y) AS nc
            FROM cleaned WHERE y = 1),
sampled AS (SELECT {cols} FROM ds_rank WHERE rk <= nc - {round_half_up_sql(f'nc * {share}')}
            UNION ALL SELECT {cols} FROM cleaned WHERE y <> 1),
sp_rank AS (SELECT *, {hash_rank_sql(P.SPLIT_SEED)} AS rk, count(*) OVER (PARTITION BY y) AS nc FROM sampled),
splitted AS (SELECT {cols}, CASE WHEN rk <= {round_half_up_sql(f'nc * {tf}')} THEN 'test' ELSE 'train' END AS split
             FROM sp_rank)"""


def numeric_prepared_ctes(features: list[str]) -> str:
    """adds ``enc`` (D1 medians, D3 ordinal) and ``scaled`` (D6/D7) for the
    numeric features in ``features`` (one-hot outputs are not produced here)."""
    meds = L.VIEW_MEDIAN_COLUMNS
    med_sel = ", ".join(f"median({c}) AS m_{c}" for c in meds)
    ords = L.VIEW_ORDINAL_COLUMNS
    cat_ctes = ",\n".join(
        f"cat_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS idx FROM "
        f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM splitted WHERE split = 'train' AND {c} IS NOT NULL))"
        for c in ords)
    enc_cols = [f"coalesce(CAST(s.{c} AS DOUBLE), med.m_{c}) AS {c}" for c in meds]
    enc_cols += [f"cat_{c}.idx AS {c}" for c in ords]
    enc_cols += [f"CAST(s.{c} AS DOUBLE) AS {c}" for c in P.PASSTHROUGH]
    joins = " ".join(f"LEFT JOIN cat_{c} ON CAST(s.{c} AS VARCHAR) = cat_{c}.v" for c in ords)
    numeric = meds + ords + P.PASSTHROUGH
    scaled_feats = [f for f in features if f in numeric]
    mm = [f for f in scaled_feats if f not in L.VIEW_FIXED_SCALES]
    mm_sel = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in mm)
    exprs = []
    for f in scaled_feats:
        if f in L.VIEW_FIXED_SCALES:
            exprs.append(f"e.{f} * {lit(float(L.VIEW_FIXED_SCALES[f]))} AS {f}")
        else:
            exprs.append(f"(e.{f} - mm.lo_{f}) / (CASE WHEN mm.hi_{f} - mm.lo_{f} <> 0 "
                         f"THEN mm.hi_{f} - mm.lo_{f} ELSE 1.0 END) AS {f}")
    return split_ctes() + f""",
med AS (SELECT {med_sel} FROM splitted WHERE split = 'train'),
{cat_ctes},
enc AS (SELECT s.loan_id, s.y, s.split, {', '.join(enc_cols)} FROM splitted s CROSS JOIN med {joins}),
mm AS (SELECT {mm_sel} FROM enc WHERE split = 'train'),
scaled AS (SELECT e.loan_id, e.y, e.split, {', '.join(exprs)} FROM enc e CROSS JOIN mm)"""


def utility_sql(features: list[str], coefs: list[float]) -> str:
    expr = lit(float(coefs[0]))
    for f, b in zip(features, coefs[1:]):
        expr = f"{expr} + {lit(float(b))} * {f}"
    return f"({expr})"


def softmax_pred_ctes(src: str, features: list[str], beta: dict[int, list[float]], keep: list[str],
                      name: str = "scored", classes=(1, 2, 3), base: int = 1) -> str:
    """adds ``<name>_u`` and ``<name>``: prob_c1..K and pred (first maximum)."""
    us = []
    for k in classes:
        us.append("CAST(0.0 AS DOUBLE)" if k == base else utility_sql(features, beta[k]))
    u_sel = ", ".join(f"{u} AS u{k}" for u, k in zip(us, classes))
    m = "greatest(" + ", ".join(f"u{k}" for k in classes) + ")"
    e_sel = ", ".join(f"exp(u{k} - m) AS e{k}" for k in classes)
    tot = " + ".join(f"e{k}" for k in classes)
    p_sel = ", ".join(f"e{k} / ({tot}) AS prob_c{k}" for k in classes)
    keep_s = ", ".join(keep)
    return f""",
{name}_u AS (SELECT {keep_s}, {u_sel} FROM {src}),
{name}_m AS (SELECT *, {m} AS m FROM {name}_u),
{name}_e AS (SELECT {keep_s}, {e_sel} FROM {name}_m),
{name}_p AS (SELECT {keep_s}, {p_sel} FROM {name}_e),
{name} AS (SELECT *, {argmax_sql([f'prob_c{k}' for k in classes], list(classes))} AS pred FROM {name}_p)"""


def argmax_sql(cols: list[str], labels: list[int]) -> str:
    """First maximum wins."""
    parts = []
    for i, c in enumerate(cols[:-1]):
        conds = " AND ".join(f"{c} >= {o}" for o in cols[i + 1:])
        prev = " AND ".join(f"{c} > {o}" for o in cols[:i])
        cond = conds if not prev else f"{prev} AND {conds}"
        parts.append(f"WHEN {cond} THEN {labels[i]}")
    return f"(CASE {' '.join(parts)} ELSE {labels[-1]} END)"


def metrics_select(src: str, group: list[str], classes=(1, 2, 3), eps: float = 2.220446049250313e-16) -> str:
    """CTE bodies computing the H1-H5 table from ``src`` (y, pred, prob_c*)."""
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    gby = f"GROUP BY {g}" if group else ""
    clip = [f"greatest(least(prob_c{k}, {lit(1 - eps)}), {lit(eps)})" for k in classes]
    tot = " + ".join(clip)
    pt = "CASE " + " ".join(f"WHEN y = {k} THEN {c}" for k, c in zip(classes, clip)) + " END"
    f1 = []
    for k in classes:
        tp = f"sum(CAST(y = {k} AND pred = {k} AS BIGINT))"
        den = f"(sum(CAST(pred = {k} AS BIGINT)) + sum(CAST(y = {k} AS BIGINT)))"
        f1.append(f"CASE WHEN {den} > 0 THEN CAST(2.0 AS DOUBLE) * {tp} / {den} ELSE CAST(0.0 AS DOUBLE) END")
    present = " + ".join(f"CASE WHEN (sum(CAST(pred = {k} AS BIGINT)) + sum(CAST(y = {k} AS BIGINT))) > 0 "
                         f"THEN 1.0 ELSE 0.0 END" for k in classes)
    f1_cols = ", ".join(f"{e} AS f1_c{k}" for e, k in zip(f1, classes))
    basic = (f"SELECT {gsel}count(*) AS n, avg(CAST(y = pred AS DOUBLE)) AS accuracy, "
             f"avg(CAST(abs(y - pred) AS DOUBLE)) AS mae, -avg(ln(({pt}) / ({tot}))) AS log_loss, "
             f"{f1_cols}, ({' + '.join(f1)}) / ({present}) AS f1_macro FROM {src} {gby}")
    stacked = " UNION ALL ".join(
        f"SELECT {gsel}{k} AS cls, prob_c{k} AS score, CAST(y = {k} AS INTEGER) AS pos FROM {src}"
        for k in classes)
    part = ", ".join(group + ["cls"])
    ranked = (f"SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score) + "
              f"CAST(count(*) OVER (PARTITION BY {part}, score) - 1 AS DOUBLE) / CAST(2.0 AS DOUBLE) AS ar FROM ({stacked})")
    per = (f"SELECT {gsel}cls, sum(pos * ar) AS r1, sum(pos) AS n1, count(*) AS n FROM ({ranked}) "
           f"GROUP BY {part}")
    auc = (f"SELECT {gsel}avg(CASE WHEN n1 > 0 AND n > n1 THEN (r1 - CAST(n1 * (n1 + 1) AS DOUBLE) / CAST(2.0 AS DOUBLE)) / CAST(n1 * (n - n1) AS DOUBLE) END) "
           f"AS auc_ovr FROM ({per}) {gby}")
    return basic, auc
