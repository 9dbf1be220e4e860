"""Entity resolution across the two derived registries."""

from pyspark.sql import functions as F

from recordloom.functions.coerce import leading_int
from recordloom.operators import entities, resolve

from .registry import query

NORM = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({}), '[.,''"()&]+', ' ', 'g'),
  '\b(LLC|LLP|LP|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|PLLC|PA|CONSULTING|GROUP|PARTNERS|HOLDINGS|GMBH|AG|SA|SARL|LIMITED|LTD|PLC|PTY|NV|BV)\b', ' ', 'g'),
  '\s+', ' ', 'g')), '')"""
POOLS = rf"""
, pa AS (SELECT DISTINCT registrant_id, registrant_name, registrant_state,
                {NORM.format('registrant_name')} AS norm_name FROM registry_a),
pb AS (SELECT DISTINCT organization_name,
              TRY_CAST(nullif(regexp_extract(senate_id, '^(\d+)', 1), '') AS INTEGER) AS bridge_id,
              state, {NORM.format('organization_name')} AS norm_name FROM registry_b),
p1 AS (SELECT DISTINCT registrant_id AS left_id, registrant_name AS left_name,
              organization_name AS right_name, 'bridge_senate_id' AS resolution_pass
       FROM pa JOIN pb ON registrant_id = bridge_id),
p2 AS (SELECT DISTINCT registrant_id AS left_id, registrant_name AS left_name,
              organization_name AS right_name, 'exact_normalized' AS resolution_pass
       FROM pa JOIN pb ON pa.norm_name = pb.norm_name
       WHERE registrant_id NOT IN (SELECT left_id FROM p1)),
p2s AS (SELECT DISTINCT registrant_id AS left_id, registrant_name AS left_name,
               organization_name AS right_name, 'exact_normalized' AS resolution_pass
        FROM pa JOIN pb ON pa.norm_name = pb.norm_name AND registrant_state = state
        WHERE registrant_id NOT IN (SELECT left_id FROM p1)),
rest AS (SELECT DISTINCT registrant_id AS left_id, registrant_name AS left_name, norm_name FROM pa
         WHERE norm_name IS NOT NULL AND registrant_id NOT IN (SELECT left_id FROM p1)
           AND registrant_id NOT IN (SELECT left_id FROM p2))"""


def pools(t):
    left = resolve.entity_pool(t.registry_a(), ident="registrant_id", name="registrant_name",
                               extra=["registrant_house_id", "registrant_state"])
    right = resolve.entity_pool(
        t.registry_b().withColumn("bridge_id", leading_int("senate_id")),
        ident="bridge_id", name="organization_name", extra=["state"], need="organization_name")
    return left, right


NAMES = {"ident": "registrant_id", "name": "registrant_name", "right_name": "organization_name"}


def passes(t):
    left, right = pools(t)
    p1 = resolve.bridge_pass(left, right, [("registrant_id", "bridge_id", "bridge_senate_id")],
                             **NAMES)
    p2 = resolve.exact_pass(left, right, p1, **NAMES)
    return left, right, p1, p2


@query("er_pool", POOLS + """
SELECT organization_name, bridge_id, state, norm_name FROM pb""")
def er_pool(t):
    return pools(t)[1].select("organization_name", "bridge_id", "state", "norm_name")


@query("er_bridge", POOLS + "\nSELECT * FROM p1")
def er_bridge(t):
    return passes(t)[2]


@query("er_exact", POOLS + "\nSELECT * FROM p2")
def er_exact(t):
    return passes(t)[3]


@query("er_exact_same_state", POOLS + "\nSELECT * FROM p2s")
def er_exact_same_state(t):
    left, right, p1, _ = passes(t)
    return resolve.exact_pass(left, right, p1, same=[("registrant_state", "state")], **NAMES)


@query("er_residual", POOLS + "\nSELECT * FROM rest")
def er_residual(t):
    left, _, p1, p2 = passes(t)
    return resolve.residual(left, [p1, p2], ident="registrant_id", name="registrant_name")


@query("er_report", POOLS + """
, c AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT 'pass:' || resolution_pass AS metric, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY 1
UNION ALL SELECT 'left_entities', count(DISTINCT registrant_id) FROM pa
UNION ALL SELECT 'right_entities', count(DISTINCT organization_name) FROM pb
UNION ALL SELECT 'matched_entities', count(DISTINCT left_id) FROM c
UNION ALL SELECT 'matched_pct', round(100.0::DOUBLE * (SELECT count(DISTINCT left_id) FROM c)
                                      / (SELECT count(DISTINCT registrant_id) FROM pa), 1)
UNION ALL SELECT 'ambiguous', (SELECT count(*) FROM rest)""")
def er_report(t):
    # the deterministic passes, with everything left over as the queue
    left, right, p1, p2 = passes(t)
    rest = resolve.residual(left, [p1, p2], ident="registrant_id", name="registrant_name")
    return resolve.resolution_report(resolve.consolidate([p1, p2]), left, right, rest,
                                     ident="registrant_id", right_name="organization_name")


@query("er_attach_canonical", POOLS + """
, c AS (SELECT left_id, min(right_name) AS canonical_name FROM
        (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY 1)
SELECT registrant_id, registrant_name, canonical_name
FROM registry_a LEFT JOIN c ON registrant_id = left_id""")
def er_attach_canonical(t):
    _, _, p1, p2 = passes(t)
    return resolve.attach_canonical(
        t.registry_a().select("registrant_id", "registrant_name"), resolve.consolidate([p1, p2]),
        ident="registrant_id")


# Every pair of names is scored: the words of both as sets, the longest common subsequence of what
# they do not share row by row of its table. Pairs whose lengths rule out 90 are not scored.
SIMILAR = POOLS + r"""
, lw AS (SELECT DISTINCT norm_name AS l, list_distinct(string_split(norm_name, ' ')) AS wl FROM rest),
rw AS (SELECT DISTINCT norm_name AS r, list_distinct(string_split(norm_name, ' ')) AS wr FROM pb WHERE norm_name IS NOT NULL),
met AS (SELECT l, r, list_sort(list_filter(wl, lambda w: list_contains(wr, w))) AS shared,
               array_to_string(list_sort(list_filter(wl, lambda w: NOT list_contains(wr, w))), ' ') AS a,
               array_to_string(list_sort(list_filter(wr, lambda w: NOT list_contains(wl, w))), ' ') AS b FROM lw, rw),
sized AS (SELECT l, r, a, b, len(shared) > 0 AS any_shared, length(array_to_string(shared, ' ')) AS n,
                 length(array_to_string(shared, ' ')) + CASE WHEN len(shared) > 0 THEN 1 ELSE 0 END AS lead FROM met),
near AS (SELECT *, any_shared AND (a = '' OR b = '') AS inside FROM sized
         WHERE (any_shared AND (a = '' OR b = '')) OR 200.0::DOUBLE * n / (n + lead + least(length(a), length(b))) >= 90
            OR 200.0::DOUBLE * (lead + least(length(a), length(b))) / (2 * lead + length(a) + length(b)) >= 90),
rests AS (SELECT a, b, list_transform(string_split(a, ''), lambda c: [ord(c)]) AS ca,
                 list_transform(string_split(b, ''), lambda c: [ord(c)]) AS cb
          FROM (SELECT DISTINCT a, b FROM near WHERE NOT inside)),
common AS (SELECT a, b, list_reduce(ca, lambda row, x: list_reduce(
               list_transform(cb, lambda y, j: [j, CASE WHEN y = x THEN row[j] + 1 ELSE row[j + 1] END]),
               lambda made, cell: list_append(made, greatest(made[len(made)], cell[2])), [0]),
             list_transform(range(len(cb) + 1), lambda z: 0))[len(cb) + 1] AS c FROM rests),
scored AS (SELECT l, r, CASE WHEN inside THEN 100.0::DOUBLE ELSE greatest(
               200.0::DOUBLE * (lead + c) / (2 * lead + length(near.a) + length(near.b)),
               CASE WHEN any_shared THEN 200.0::DOUBLE * n / (n + lead + least(length(near.a), length(near.b))) ELSE 0 END) END AS score
           FROM near LEFT JOIN common ON near.a = common.a AND near.b = common.b AND NOT inside),
candidates AS (SELECT DISTINCT l, score, r, organization_name AS right_name
               FROM scored JOIN pb ON r = pb.norm_name WHERE score >= 92),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r, right_name) AS k FROM candidates),
judged AS (SELECT l, max(CASE WHEN k = 1 THEN right_name END) AS right_name, max(score) AS score,
                  coalesce(max(CASE WHEN k = 2 THEN score END) >= max(score) - 2, false) AS ambiguous,
                  string_agg(r, ' | ' ORDER BY k) AS candidates,
                  string_agg(CAST(round(score, 4) AS VARCHAR), ',' ORDER BY k) AS scores
           FROM ranked WHERE k <= 3 GROUP BY l),
p3 AS (SELECT left_id, left_name, right_name, 'fuzzy' AS resolution_pass, score
       FROM rest JOIN judged ON norm_name = l WHERE NOT ambiguous)"""


def _fuzzy(t):
    left, right, p1, p2 = passes(t)
    rest = resolve.residual(left, [p1, p2], ident="registrant_id", name="registrant_name")
    return resolve.fuzzy_pass(rest, right, right_name="organization_name"), p1, p2


@query("er_fuzzy", SIMILAR + "\nSELECT * FROM p3")
def er_fuzzy(t):
    return _fuzzy(t)[0][0]


@query("er_ambiguous", SIMILAR + """
SELECT left_id, left_name, candidates, scores FROM rest JOIN judged ON norm_name = l WHERE ambiguous""")
def er_ambiguous(t):
    return _fuzzy(t)[0][1]


@query("er_canonical", SIMILAR + """
SELECT *, NULL::DOUBLE AS score FROM p1 UNION ALL SELECT *, NULL FROM p2 UNION ALL SELECT * FROM p3""")
def er_canonical(t):
    (accepted, _), p1, p2 = _fuzzy(t)
    return resolve.consolidate([p1, p2, accepted])


@query("er_entities", POOLS + """
, ra AS (SELECT 'a:' || registrant_id AS record, registrant_id AS bridge, norm_name FROM pa),
rb AS (SELECT DISTINCT 'b:' || organization_name AS record, bridge_id AS bridge, norm_name FROM pb),
keyed AS (
  SELECT record, 'bridge|' || bridge AS key FROM ra UNION SELECT record, 'name|' || norm_name FROM ra
  UNION SELECT record, 'bridge|' || bridge FROM rb WHERE bridge IS NOT NULL
  UNION SELECT record, 'name|' || norm_name FROM rb WHERE norm_name IS NOT NULL),
tied AS (SELECT record, min(record) OVER (PARTITION BY key) AS near FROM keyed),
steps AS (SELECT record AS a, near AS b FROM tied UNION SELECT near, record FROM tied)
SELECT record, entity, count(*) OVER (PARTITION BY entity) AS n_records FROM (
  WITH RECURSIVE reach AS (
    SELECT a AS record, a AS other FROM steps
    UNION SELECT r.record, s.b FROM reach r JOIN steps s ON r.other = s.a)
  SELECT record, min(other) AS entity FROM reach GROUP BY 1)""")
def er_entities(t):
    """Registrants of both registries tied by bridge id and by name, over chains of either."""
    left, right = pools(t)
    left = left.withColumn("record", entities.record_id("a", "registrant_id"))
    right = right.withColumn("record", entities.record_id("b", "organization_name"))
    return entities.canonical_entities([
        (left, {"bridge": [F.col("registrant_id")], "name": [F.col("norm_name")]}),
        (right, {"bridge": [F.col("bridge_id")], "name": [F.col("norm_name")]})])
