"""A plan as a DataFrame: scans, joins, filters, aggregation, merge of states, finalizers, order and limit.

Everything is declarative, so Catalyst prunes columns, pushes filters to the scans, turns left joins under null-rejecting
filters into inner ones, and picks join strategies by size; adaptive execution splits skewed ones. Dimension joins are
not hinted: whether a side is broadcast is Spark's choice by its measured size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.catalog import spark_type, type_family

Source = Callable[[str, str], DataFrame]
MERGE = {"SUM": F.sum, "COUNT": F.sum, "MIN": F.min, "MAX": F.max}


def _dimension(df: DataFrame, sql: str, name: str, data_type: str | None) -> Column:
    """A dimension; one declared DATE is a date even if its expression gives a timestamp."""
    column = F.expr(sql)
    if data_type and data_type.strip().upper() == "DATE":
        column = column.cast("date")
    return column.alias(name)


def _conjunction(parts: list[str]) -> Column | None:
    out = None
    for p in parts:
        out = F.expr(p) if out is None else out & F.expr(p)
    return out


def _mapped(df: DataFrame, source: Source, mapping: dict | None, key: list[str], alias: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the semantic key of a mapping relation beside its local key."""
    if not mapping:
        return df, key
    name = f"{alias}__map"
    table = source(mapping["schema"], mapping["object"]).alias(name)
    joined = df.join(table, F.expr(f"{key[0]} = {name}.`{mapping['source_column']}`"), "left")
    return joined, [f"{name}.`{mapping['semantic_column']}`"]


def scan(source: Source, branch: dict) -> DataFrame:
    """A branch's base with its joins, filters applied."""
    df = source(branch["schema"], branch["object"]).alias(branch["alias"])
    for j in branch["joins"]:
        right = source(j["schema"], j["object"]).alias(j["alias"])
        if "condition" in j:
            df = df.join(right, F.expr(j["condition"]), j["how"])
            continue
        df, left_key = _mapped(df, source, j["left_map"], j["left"], branch["alias"])
        right, right_key = _mapped(right, source, j["right_map"], j["right"], j["alias"])
        on = _conjunction([f"{a} = {b}" for a, b in zip(left_key, right_key, strict=True)])
        df = df.join(right, on, "left")
    where = _conjunction(branch["where"])
    return df if where is None else df.where(where)


def states(source: Source, branch: dict, dimensions: list[dict]) -> DataFrame:
    """A branch's partial result: its dimensions and its own units."""
    if "materialization" in branch:
        m = branch["materialization"]
        df = source(m["schema"], m["object"]).alias("mat")
        where = _conjunction(branch["where"])
        df = df if where is None else df.where(where)
        keys = [F.expr(f"mat.`{m['dimensions'][d['name']]}`").alias(d["name"]) for d in dimensions]
        aggregates = [F.sum(F.expr(f"mat.`{m['states'][u]}`")).alias(u) for u in branch["units"]]
        return df.groupBy(*keys).agg(*aggregates)
    df = scan(source, branch)
    keys = [_dimension(df, branch["dimensions"][d["name"]], d["name"], d["data_type"]) for d in dimensions]
    aggregates = [F.expr(branch["aggregates"][u]).alias(u) for u in branch["units"]]
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates)


def by_leaf(branches: list[dict]) -> list[list[dict]]:
    """Branches that are read together: the temporal partitions of one leaf, any other alone."""
    out: list[list[dict]] = []
    for b in branches:
        if out and "inputs" in b and "inputs" in out[-1][0] and out[-1][0]["entity"] == b["entity"]:
            out[-1].append(b)
        else:
            out.append([b])
    return out


def _united(parts: list[DataFrame], columns: list[str]) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Union of frames by name, columns widened and null where a frame lacks them, with the types."""
    kinds: dict[str, T.DataType] = {}
    for p in parts:
        for f in p.schema.fields:
            known = kinds.get(f.name)
            kinds[f.name] = f.dataType if known is None else _wider(known, f.dataType)
    aligned = [p.select(*[(F.col(f"`{c}`") if c in p.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]) for p in parts]
    union = aligned[0]
    for p in aligned[1:]:
        union = union.unionByName(p)
    return union, kinds


def folded(source: Source, partitions: list[dict], dimensions: list[dict]) -> DataFrame:
    """The partial result of a leaf's partitions: their rows are united first and aggregated once."""
    functions = {u: f for u, (f, _) in partitions[0]["inputs"].items()}
    rows = []
    for b in partitions:
        df = scan(source, b)
        keys = [_dimension(df, b["dimensions"][d["name"]], d["name"], d["data_type"]) for d in dimensions]
        counted = {u: F.expr(sql).isNotNull() for u, (f, sql) in b["inputs"].items() if f == "COUNT"}
        values = [(F.when(counted[u], 1) if u in counted else F.expr(sql)).alias(u) for u, (_, sql) in b["inputs"].items()]
        rows.append(df.select(*keys, *values))
    names = [d["name"] for d in dimensions]
    union, _ = _united(rows, [*names, *functions])
    if not functions:
        return union.distinct()
    return union.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[(F.count if f == "COUNT" else F.sum)(F.col(f"`{u}`")).alias(u) for u, f in functions.items()])


def merged(source: Source, plan: dict) -> DataFrame:
    """States of all leaves, merged by dimension; COUNT states are 0 where no leaf had rows."""
    dimensions = plan["dimensions"]
    leaves = by_leaf(plan["branches"])
    parts = [folded(source, p, dimensions) if len(p) > 1 else states(source, p[0], dimensions) for p in leaves]
    if plan["kind"] == "SINGLE_BRANCH" or (len(parts) == 1 and len(leaves[0]) > 1):
        return parts[0]
    names = [d["name"] for d in dimensions]
    union, kinds = _united(parts, [*names, *(u["column"] for u in plan["units"])])
    merges = []
    for u in plan["units"]:
        total = F.sum(F.col(f"`{u['column']}`")).cast(kinds[u["column"]])
        merges.append((F.coalesce(total, F.lit(0).cast(kinds[u["column"]])) if u["function"] == "COUNT" else total).alias(u["column"]))
    return union.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*merges)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)):
        return T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return b if isinstance(b, T.DecimalType) else a if isinstance(a, T.DecimalType) else T.LongType()
    return b if isinstance(a, T.NullType) else a if isinstance(b, T.NullType) else T.StringType()


def materialized(source: Source, plan: dict) -> DataFrame:
    """A whole request from a registered aggregate: passed through at its own grain, else rolled up."""
    m = plan["materialization"]
    df = source(m["schema"], m["object"]).alias("mat")
    where = _conjunction(plan["filters_sql"])
    df = df if where is None else df.where(where)
    keys = [_dimension(df, f"mat.`{m['dimensions'][d['name']]}`", d["name"], d["data_type"]) for d in plan["dimensions"]]
    if not m["grouped"]:
        return df.select(*keys, *[F.expr(f"mat.`{m['metrics'][x['name']][0]}`").alias(x["name"]) for x in plan["metrics"]])
    aggregates = []
    for x in plan["metrics"]:
        column, policy = m["metrics"][x["name"]]
        merge = MERGE.get(policy, F.sum if m["rollup"] else F.max)
        aggregates.append(merge(F.expr(f"mat.`{column}`")).alias(x["name"]))
    return df.groupBy(*keys).agg(*aggregates)


def lower(source: Source, plan: dict, typed: bool = False) -> DataFrame:
    """The DataFrame of a plan: dimensions, then metrics, in request order.

    ``typed`` casts outputs to their declared types. Nulls sort last both ways; under a limit, ties are broken by the
    outputs in order, so a limited result is the same every time.
    """
    outputs = [d["name"] for d in plan["dimensions"]] + [m["name"] for m in plan["metrics"]]
    if plan["materialization"]:
        df = materialized(source, plan)
    else:
        df = merged(source, plan)
        for f in plan["finalizers"]:
            df = df.withColumn(f["column"], F.expr(f["sql"]))
        where = _conjunction([h["sql"] for h in plan["having"]])
        df = df if where is None else df.where(where)
        df = df.select(
            *[F.col(f"`{d['name']}`") for d in plan["dimensions"]], *[F.col(f"`__m_{m['name'].lower()}`").alias(m["name"]) for m in plan["metrics"]]
        )
    if typed:
        declared = {x["name"]: x["data_type"] for x in plan["dimensions"] + plan["metrics"] if type_family(x["data_type"]) not in (None, "other")}
        df = df.select(*[F.col(f"`{n}`").cast(spark_type(declared[n])).alias(n) if n in declared else F.col(f"`{n}`") for n in outputs])
    if plan["order_by"]:
        keys = [(F.col(f"`{o['field']}`").desc_nulls_last() if o["direction"] == "DESC" else F.col(f"`{o['field']}`").asc_nulls_last()) for o in plan["order_by"]]
        if plan["limit"]:
            named = {o["field"] for o in plan["order_by"]}
            keys += [F.col(f"`{n}`").asc_nulls_last() for n in outputs if n not in named]
        df = df.orderBy(*keys)
    return df.limit(plan["limit"]) if plan["limit"] else df


# -- the same plan as text, for logs and EXPLAIN ---------------------------------------------------------------
def render_sql(plan: dict) -> str:
    """Spark SQL that says what ``lower`` builds."""
    names = [d["name"] for d in plan["dimensions"]]
    group = f" GROUP BY {', '.join(str(k + 1) for k in range(len(names)))}" if names else ""
    if plan["materialization"]:
        m = plan["materialization"]
        columns = [f"mat.`{m['dimensions'][n]}` AS `{n}`" for n in names]
        for x in plan["metrics"]:
            column, policy = m["metrics"][x["name"]]
            function = "SUM" if policy == "COUNT" else policy if policy in MERGE else "MAX"
            columns.append(f"{function}(mat.`{column}`) AS `{x['name']}`" if m["grouped"] else f"mat.`{column}` AS `{x['name']}`")
        text = f"SELECT {', '.join(columns)} FROM `{m['schema']}`.`{m['object']}` mat"
        text += (f" WHERE {' AND '.join(plan['filters_sql'])}" if plan["filters_sql"] else "") + (group if m["grouped"] else "")
    else:
        text = _render_branches(plan, names, group)
    if plan["order_by"]:
        text += " ORDER BY " + ", ".join(f"`{o['field']}` {o['direction']} NULLS LAST" for o in plan["order_by"])
    return text + (f" LIMIT {plan['limit']}" if plan["limit"] else "")


def _render_scan(branch: dict) -> str:
    text = f"`{branch['schema']}`.`{branch['object']}` {branch['alias']}"
    for j in branch["joins"]:
        on = j.get("condition") or " AND ".join(f"{x} = {y}" for x, y in zip(j["left"], j["right"], strict=True))
        text += f" {j['how'].upper()} JOIN `{j['schema']}`.`{j['object']}` {j['alias']} ON {on}"
    return text


def _render_branches(plan: dict, names: list[str], group: str) -> str:
    units = [u["column"] for u in plan["units"]]
    parts = []
    for leaf in by_leaf(plan["branches"]):
        b = leaf[0]
        if len(leaf) > 1:
            rows = []
            for p in leaf:
                columns = [f"{p['dimensions'][n]} AS `{n}`" for n in names]
                columns += [f"CASE WHEN ({sql}) IS NOT NULL THEN 1 END AS `{u}`" if f == "COUNT" else f"{sql} AS `{u}`" for u, (f, sql) in p["inputs"].items()]
                text = f"SELECT {', '.join(columns)} FROM {_render_scan(p)}"
                rows.append(text + (f" WHERE {' AND '.join(p['where'])}" if p["where"] else ""))
            columns = [f"`{n}`" for n in names] + [f"{b['inputs'][u][0]}(`{u}`) AS `{u}`" if u in b["units"] else f"NULL AS `{u}`" for u in units]
            parts.append(f"SELECT {', '.join(columns)} FROM ({' UNION ALL '.join(rows)}) {b['alias']}{group}")
            continue
        if "materialization" in b:
            m = b["materialization"]
            columns = [f"mat.`{m['dimensions'][n]}` AS `{n}`" for n in names]
            columns += [f"SUM(mat.`{m['states'][u]}`) AS `{u}`" if u in b["units"] else f"NULL AS `{u}`" for u in units]
            text = f"SELECT {', '.join(columns)} FROM `{m['schema']}`.`{m['object']}` mat"
        else:
            columns = [f"{b['dimensions'][n]} AS `{n}`" for n in names]
            columns += [f"{b['aggregates'][u]} AS `{u}`" if u in b["units"] else f"NULL AS `{u}`" for u in units]
            text = f"SELECT {', '.join(columns)} FROM {_render_scan(b)}"
        parts.append(text + (f" WHERE {' AND '.join(b['where'])}" if b["where"] else "") + group)
    steps = [f"states AS ({' UNION ALL '.join(parts)})"]
    if plan["kind"] == "MULTI_BRANCH":
        merges = [f"{'COALESCE(SUM(`%s`), 0)' % u['column'] if u['function'] == 'COUNT' else 'SUM(`%s`)' % u['column']} AS `{u['column']}`" for u in plan["units"]]
        steps.append(f"merged AS (SELECT {', '.join([f'`{n}`' for n in names] + merges)} FROM states{group})")
    last = "merged" if plan["kind"] == "MULTI_BRANCH" else "states"
    for k, f in enumerate(plan["finalizers"]):
        steps.append(f"final_{k} AS (SELECT *, {f['sql']} AS `{f['column']}` FROM {last})")
        last = f"final_{k}"
    columns = [f"`{n}`" for n in names] + [f"`__m_{m['name'].lower()}` AS `{m['name']}`" for m in plan["metrics"]]
    having = f" WHERE {' AND '.join(h['sql'] for h in plan['having'])}" if plan["having"] else ""
    return f"WITH {', '.join(steps)} SELECT {', '.join(columns)} FROM {last}{having}"
