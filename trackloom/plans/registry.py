"""A query is registered with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: The track views as SQL.
EV = "ev AS MATERIALIZED (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v FROM events)"
LI = (
    "li AS MATERIALIZED (SELECT l_partkey AS entity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS frame,"
    " l_quantity::BIGINT AS c0, round(l_discount * 100)::BIGINT AS c1, round(l_tax * 100)::BIGINT AS c2 FROM lineitem)"
)
EMB = (
    "emb AS (SELECT vec_id AS splat_id, label::BIGINT AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,"
    + ", ".join(f" least(greatest(round(embedding[{4 + k}]::DOUBLE / norm * 128), -128), 127)::BIGINT AS q{k}" for k in range(4))
    + ", embedding[8]::DOUBLE AS s0, embedding[9]::DOUBLE AS s1, embedding[10]::DOUBLE AS s2 FROM (SELECT *, sqrt("
    + " + ".join(f"embedding[{k}]::DOUBLE * embedding[{k}]::DOUBLE" for k in (4, 5, 6, 7))
    + ") AS norm FROM embeddings WHERE embedding IS NOT NULL))"
)
HELD = f"{EV}, held AS (SELECT entity, frame, round(v / 4.0)::BIGINT AS b FROM ev)"
GOP = 10
SYMBOLS = (
    f"{HELD}, g AS (SELECT *, frame // {GOP} AS gop, row_number() OVER (PARTITION BY entity, frame // {GOP} ORDER BY frame) AS rn, lag(b) OVER (PARTITION BY entity, frame // {GOP} ORDER BY frame) AS p FROM held),"
    " d AS (SELECT entity, frame, gop::BIGINT AS gop, CASE WHEN rn = 1 THEN 0 ELSE 1 END::BIGINT AS kind, CASE WHEN rn = 1 THEN b ELSE b - p END AS n FROM g),"
    " sy AS (SELECT entity, frame, gop, kind, 'b' AS attr, (CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END)::BIGINT AS sym FROM d)"
)
PLANES = (
    SYMBOLS + ", wd AS (SELECT gop, attr, kind, CASE WHEN max(sym) < 256 THEN 1 WHEN max(sym) < 65536 THEN 2 ELSE 4 END AS width FROM sy GROUP BY ALL),"
    " pl AS (SELECT gop, attr, kind, plane, ((sym >> (8 * plane)::BIGINT) & 255)::BIGINT AS byte FROM (SELECT sy.*, unnest(range(0, width))::BIGINT AS plane FROM sy JOIN wd USING (gop, attr, kind)))"
)
