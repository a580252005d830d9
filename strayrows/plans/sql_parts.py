"""Common table expressions the comparison SQL is put together from."""

from __future__ import annotations

from collections.abc import Sequence

from strayrows.functions.tokens import projection_weights
from strayrows.operators.chains import ChainPlan
from strayrows.operators.countmin import SketchShape


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def num(v: float) -> str:
    return f"{v!r}::DOUBLE"


ORDER_FEATURES = """of AS MATERIALIZED (
  SELECT o_orderkey AS row_id, o_totalprice, n_lines, qty, max_price, max_disc,
         o_orderstatus, o_orderpriority
  FROM orders JOIN (
    SELECT l_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS qty,
           max(l_extendedprice) AS max_price, max(l_discount) AS max_disc
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def long_vectors(source: str, columns: Sequence[str], name: str = "xs") -> str:
    """(row_id, dim, x), one row per vector entry."""
    selects = [
        f"SELECT row_id, {i} AS dim, {c}::DOUBLE AS x FROM {source}" for i, c in enumerate(columns)
    ]
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(selects) + ")"


def half_ranges(vectors: str = "xs", name: str = "rng", where: str = "") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT dim, min(x) AS lo, max(x) AS hi,
         CASE WHEN max(x) = min(x) THEN 1.0::DOUBLE ELSE (max(x) - min(x)) / 2.0::DOUBLE END AS delta
  FROM {vectors} {where} GROUP BY dim)"""


def plan_values(plan: ChainPlan, name: str = "plan") -> str:
    """(chain, depth, split, dim, mult, u): the bin terms of every chain and depth."""
    rows = []
    for c in range(plan.n_chains):
        for d, counts in enumerate(plan.uses(c)):
            for k, m in sorted(counts.items()):
                rows.append(
                    f"({c},{d + 1},{plan.dims[c][d]},{k},{num(2.0 ** (m - 1))},{num(plan.shift[c][k])})"
                )
    return f"{name}(chain, depth, split, dim, mult, u) AS MATERIALIZED (VALUES {', '.join(rows)})"


def bins(vectors: str = "xs", rng: str = "rng", plan: str = "plan", name: str = "bins") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT row_id, chain, depth, split, string_agg(b::VARCHAR, ',' ORDER BY dim) AS bin
  FROM (SELECT row_id, chain, depth, split, p.dim,
               floor((mult * x + u * delta) / delta)::BIGINT AS b
        FROM {vectors} v JOIN {plan} p ON v.dim = p.dim JOIN {rng} r ON r.dim = p.dim)
  GROUP BY row_id, chain, depth, split)"""


SKETCH = """sketch AS MATERIALIZED (
  SELECT chain, depth, bin, count(*) AS cnt FROM bins GROUP BY chain, depth, bin)"""

DEPTH_VALUES = """depth_values AS MATERIALIZED (
  SELECT row_id, b.chain, b.depth, split,
         log2(1.0::DOUBLE + coalesce(cnt, 0)) + b.depth AS v
  FROM bins b LEFT JOIN sketch s
    ON s.chain = b.chain AND s.depth = b.depth AND s.bin = b.bin)"""


def scores(per_ensemble: int | None = None) -> str:
    if per_ensemble is None:
        return """scores AS MATERIALIZED (
  SELECT row_id, round(-avg(m), 9) AS score
  FROM (SELECT row_id, chain, min(v) AS m FROM depth_values GROUP BY row_id, chain)
  GROUP BY row_id)"""
    return f"""scores AS MATERIALIZED (
  SELECT row_id, chain // {per_ensemble} AS ensemble, round(-avg(m), 9) AS score
  FROM (SELECT row_id, chain, min(v) AS m FROM depth_values GROUP BY row_id, chain)
  GROUP BY row_id, chain // {per_ensemble})"""


def top(k: int, name: str = "top_rows") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT row_id, score FROM scores ORDER BY score DESC, row_id LIMIT {k})"""


def detection(plan: ChainPlan, columns: Sequence[str]) -> list[str]:
    """Scores of the order view, from scratch."""
    return [
        ORDER_FEATURES,
        long_vectors("of", columns),
        half_ranges(),
        plan_values(plan),
        bins(),
        SKETCH,
        DEPTH_VALUES,
        scores(),
    ]


def weight_values(tokens: Sequence[str], n_dims: int, signed: bool = True, name: str = "proj") -> str:
    """(token, k, r): projection weights of the given tokens."""
    w = projection_weights(tokens, n_dims, signed)
    rows = [
        f"('{t}',{k},{num(float(w[i, k]))})" for i, t in enumerate(tokens) for k in range(n_dims)
    ]
    return f"{name}(token, k, r) AS MATERIALIZED (VALUES {', '.join(rows)})"


def count_min(
    plan: ChainPlan, shape: SketchShape, n_dims: int, vectors: str = "xs", rng: str = "rng"
) -> list[str]:
    """cm_values(row_id, chain, depth, v): depth values by count-min counters of the rows in `vectors`.

    A cell's hash is a running sum: a split adds what its dimension's bin has changed by. `n_dims` is the number of
    dimensions of one ensemble; those of stacked ones follow each other.
    """
    mult = shape.multipliers(n_dims)
    rows = []
    for c in range(plan.n_chains):
        for d, uses in enumerate(plan.uses(c)):
            k = plan.dims[c][d]
            own = ",".join(f"{int(mult[j, k % n_dims])}::HUGEINT" for j in range(shape.hashes))
            rows.append(f"({c},{d + 1},{k},{num(2.0 ** (uses[k] - 1))},{num(plan.shift[c][k])},[{own}])")
    wrap = 2**64
    bucket = f"((((sum(b * a[{{j}}]) OVER w) % {wrap}) + {wrap}) % {wrap}) // {2 ** (64 - shape.bits)}"
    hashes = ", ".join(f"({bucket.format(j=j + 1)})::INT AS b{j}" for j in range(shape.hashes))
    counts = ", ".join(f"count(*) OVER (PARTITION BY chain, depth, b{j})" for j in range(shape.hashes))
    return [
        f"cm_plan(chain, depth, dim, mult, u, a) AS MATERIALIZED (VALUES {', '.join(rows)})",
        f"""cm_steps AS MATERIALIZED (
  SELECT row_id, chain, depth, a, (floor((mult * x + u * delta) / delta)
         - CASE WHEN mult > 1 THEN floor((mult / 2 * x + u * delta) / delta) ELSE 0 END)::HUGEINT AS b
  FROM {vectors} v JOIN cm_plan p ON v.dim = p.dim JOIN {rng} r ON r.dim = p.dim)""",
        f"""cm_hashed AS MATERIALIZED (
  SELECT row_id, chain, depth, {hashes} FROM cm_steps WINDOW w AS (PARTITION BY row_id, chain ORDER BY depth))""",
        f"""cm_values AS MATERIALIZED (
  SELECT row_id, chain, depth, log2(1.0::DOUBLE + least({counts})) + depth AS v FROM cm_hashed)""",
    ]
