"""The registered queries as plain SQL, for checking on another engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

WIDTH = 7776000

LINE_FLOWS = f"""line_flows AS (
  SELECT CASE WHEN l_suppkey = 0 THEN '' ELSE '10.0.0.' || l_suppkey END AS srcAddr,
         1024 + l_orderkey % 500 AS srcPort,
         '10.1.' || (l_partkey // 256) || '.' || (l_partkey % 256) AS dstAddr,
         l_partkey % 100 AS dstPort,
         l_orderkey // 4 AS sampledFlow,
         CAST(floor(l_extendedprice) AS BIGINT) AS numBytes,
         CAST(l_quantity AS BIGINT) AS numPackets,
         CAST(100 + l_linenumber % 3 AS BIGINT) AS vlanID,
         CAST(floor(epoch(l_shipdate)) AS BIGINT) AS timestampStart,
         CAST(floor(epoch(l_shipdate)) AS BIGINT) // {WIDTH} * {WIDTH} AS windowStart
  FROM lineitem)"""

EVENT_FLOWS = """event_flows AS (
  SELECT '10.0.0.' || user_id AS srcAddr,
         1024 + event_id % 500 AS srcPort,
         '10.2.0.' || (event_id % 37) AS dstAddr,
         CAST(props->>'$.k' AS BIGINT) AS dstPort,
         event_id // 3 AS sampledFlow,
         event_id % 64 AS tcpFlags,
         CAST(6 AS BIGINT) AS protocol,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestampStart,
         CAST(floor(epoch(ts)) AS BIGINT) + 1 AS timestampEnd,
         CAST(round(value * 100) AS BIGINT) AS numBytes,
         1 + event_id % 7 AS numPackets,
         100 + event_id % 5 AS vlanID
  FROM events)"""

# ---- messages and flow records ----

SQL["flow_decode"] = f"""WITH {EVENT_FLOWS}
SELECT srcAddr AS "SrcAddr", srcPort AS "SrcPort", dstAddr AS "DstAddr", dstPort AS "DstPort",
       sampledFlow AS "SequenceNum", tcpFlags AS "TCPFlags", protocol AS "Proto",
       timestampStart AS "TimeFlowStart", timestampEnd AS "TimeFlowEnd",
       numBytes AS "Bytes", numPackets AS "Packets", vlanID AS "VlanId"
FROM event_flows"""
SQL["flow_normalize"] = f"WITH {EVENT_FLOWS} SELECT * FROM event_flows"
SQL["flow_valid"] = f"WITH {EVENT_FLOWS} SELECT * FROM event_flows WHERE srcAddr IS NOT NULL"
SQL["flow_addressed"] = f"""WITH {EVENT_FLOWS}
SELECT * REPLACE (CASE tcpFlags % 8 WHEN 5 THEN '' ELSE srcAddr END AS srcAddr) FROM event_flows WHERE tcpFlags % 8 <> 1"""
SQL["flow_pair_counts"] = f"""WITH {LINE_FLOWS}
SELECT srcAddr, dstAddr, count(*) AS pairCount FROM line_flows GROUP BY ALL"""

SQL["flow_rejected"] = f"""WITH {EVENT_FLOWS}, turned AS (SELECT *, tcpFlags % 40 AS turn FROM event_flows)
SELECT CASE turn WHEN 0 THEN 'missing' WHEN 10 THEN 'text' WHEN 20 THEN 'type' ELSE 'null' END AS kind, count(*) AS n
FROM turned WHERE turn IN (0, 10, 20, 30) GROUP BY kind
UNION ALL
SELECT 'packets kept', CAST(sum(numPackets) AS BIGINT) FROM turned WHERE turn NOT IN (0, 10, 20, 30)"""

# ---- single measures ----


def _measure(key: str, expression: str, name: str) -> str:
    return f"""WITH {LINE_FLOWS}
SELECT windowStart, {key}, CAST({expression} AS BIGINT) AS {name}
FROM line_flows GROUP BY windowStart, {key}"""


SQL["src_sum_bytes"] = _measure("srcAddr", "sum(numBytes)", "sumOfBytes")
SQL["src_sum_packets"] = _measure("srcAddr", "sum(numPackets)", "sumOfPackets")
SQL["src_sum_flows"] = _measure("srcAddr", "count(DISTINCT sampledFlow)", "sumOfFlows")
SQL["src_uniq_dst_ips"] = _measure("srcAddr", "count(DISTINCT dstAddr)", "uniqDstIPs")
SQL["src_uniq_dst_ports"] = _measure("srcAddr", "count(DISTINCT dstPort)", "uniqDstPorts")
SQL["dst_sum_bytes"] = _measure("dstAddr", "sum(numBytes)", "destSumOfBytes")
SQL["dst_sum_packets"] = _measure("dstAddr", "sum(numPackets)", "destSumOfPackets")
SQL["dst_sum_flows"] = _measure("dstAddr", "count(DISTINCT sampledFlow)", "destSumOfFlows")
SQL["dst_uniq_src_ips"] = _measure("dstAddr", "count(DISTINCT srcAddr)", "uniqSrcIPs")
SQL["dst_uniq_src_ports"] = _measure("dstAddr", "count(DISTINCT srcPort)", "uniqSrcPorts")
SQL["src_vlans"] = f"""WITH {LINE_FLOWS}
SELECT DISTINCT windowStart, srcAddr, vlanID FROM line_flows"""

# ---- profiles ----

SOURCE = """source_totals AS (
  SELECT windowStart, srcAddr,
         count(DISTINCT sampledFlow) AS sumOfFlows,
         CAST(sum(numBytes) AS BIGINT) AS sumOfBytes,
         CAST(sum(numPackets) AS BIGINT) AS sumOfPackets,
         count(DISTINCT dstAddr) AS uniqDstIPs,
         count(DISTINCT dstPort) AS uniqDstPorts
  FROM {flows} GROUP BY windowStart, srcAddr),
source_rows AS (
  SELECT v.windowStart, v.vlanID, v.srcAddr, t.sumOfFlows, t.sumOfBytes, t.sumOfPackets,
         t.uniqDstIPs, t.uniqDstPorts
  FROM (SELECT DISTINCT windowStart, srcAddr, vlanID FROM {flows}) v
  JOIN source_totals t ON t.windowStart = v.windowStart AND t.srcAddr = v.srcAddr)"""
LINE_SOURCE = SOURCE.format(flows="line_flows")

SQL["source_profile"] = f"WITH {LINE_FLOWS}, {LINE_SOURCE} SELECT * FROM source_rows"
SQL["dest_profile"] = f"""WITH {LINE_FLOWS}
SELECT windowStart, dstAddr,
       count(DISTINCT sampledFlow) AS destSumOfFlows,
       CAST(sum(numBytes) AS BIGINT) AS destSumOfBytes,
       CAST(sum(numPackets) AS BIGINT) AS destSumOfPackets,
       count(DISTINCT srcAddr) AS uniqSrcIPs,
       count(DISTINCT srcPort) AS uniqSrcPorts
FROM line_flows GROUP BY windowStart, dstAddr"""

SQL["source_profile_sketched"] = f"WITH {LINE_FLOWS}, {LINE_SOURCE} SELECT *, true AS near FROM source_rows"
SQL["dest_profile_sketched"] = f"SELECT *, true AS near FROM ({SQL['dest_profile']})"

# ---- history, documents, archive ----

SQL["collected_history"] = f"""WITH {EVENT_FLOWS}, one_window AS (SELECT *, 0 AS windowStart FROM event_flows),
{SOURCE.format(flows="one_window")}
SELECT vlanID, srcAddr, sumOfFlows, sumOfBytes, sumOfPackets, uniqDstIPs, uniqDstPorts, 2 AS copies FROM source_rows"""

SQL["history_scan"] = SQL["source_profile"]
SQL["map_doc_unpack"] = f"""WITH {LINE_FLOWS}, {LINE_SOURCE}
SELECT sumOfBytes, sumOfFlows, sumOfPackets, uniqDstIPs, uniqDstPorts FROM source_rows"""
SQL["profile_documents"] = f"""WITH {LINE_FLOWS}, {LINE_SOURCE}
SELECT 1700000000000 AS date,
       CAST(json_object('vlanID', vlanID, 'srcAddr', srcAddr, 'sumOfFlows', sumOfFlows,
                        'sumOfBytes', sumOfBytes, 'sumOfPackets', sumOfPackets,
                        'uniqDstIPs', uniqDstIPs, 'uniqDstPorts', uniqDstPorts,
                        'date', 1700000000000) AS VARCHAR) AS json
FROM source_rows"""
SQL["raw_flow_daily"] = f"""WITH {EVENT_FLOWS}
SELECT strftime(DATE '1970-01-01' + CAST(timestampStart // 86400 AS INTEGER), '%Y-%m-%d') AS "ingestDate",
       srcAddr AS "SrcAddr", srcPort AS "SrcPort", dstAddr AS "DstAddr", dstPort AS "DstPort",
       sampledFlow AS "SequenceNum", tcpFlags AS "TCPFlags", protocol AS "Proto",
       timestampStart AS "TimeFlowStart", timestampEnd AS "TimeFlowEnd",
       numBytes AS "Bytes", numPackets AS "Packets", vlanID AS "VlanId"
FROM event_flows"""

# ---- features ----

FEATURE_NAMES = ["sumOfBytes", "sumOfFlows", "sumOfPackets", "uniqDstIPs", "uniqDstPorts"]
_FLOATS = ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in FEATURE_NAMES)
LINE_FEATURES = f"""{LINE_FLOWS}, {LINE_SOURCE}, line_features AS (
  SELECT windowStart, srcAddr, vlanID, {_FLOATS} FROM source_rows WHERE srcAddr <> '')"""


def _scaled(table: str, key: str) -> str:
    stats = ", ".join(f"stddev_samp({f}) AS d_{f}" for f in FEATURE_NAMES)
    values = ", ".join(
        f"round(CASE WHEN d_{f} = 0 THEN 0 ELSE {f} / d_{f} END, 6) AS {f}" for f in FEATURE_NAMES
    )
    return f"SELECT {key}, {values} FROM {table}, (SELECT {stats} FROM {table}) deviations"


SQL["score_input"] = f"WITH {LINE_FLOWS}, {LINE_SOURCE} SELECT * FROM source_rows WHERE srcAddr <> ''"
SQL["feature_cast"] = f"WITH {LINE_FEATURES} SELECT * FROM line_features"
SQL["scaler_stats"] = f"WITH {LINE_FEATURES} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(stddev_samp({f}), 6) AS std FROM line_features" for f in FEATURE_NAMES
)
SQL["scaler_moments"] = SQL["scaler_stats"]
SQL["scaled_features"] = f"WITH {LINE_FEATURES} " + _scaled("line_features", "windowStart, srcAddr, vlanID")

_PARTS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(FEATURE_NAMES))
LABELLED = f"""labelled AS (
  SELECT vec_id AS id,
         CAST((embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + 4 * (embedding[3] > 0)::INT AS BIGINT)
           AS prediction,
         {_PARTS}
  FROM embeddings)"""
SQL["labelled_features"] = f"WITH {LABELLED} " + _scaled("labelled", "id, prediction")

# ---- clustering ----

_MEANS = ", ".join(f"avg({f}) AS {f}" for f in FEATURE_NAMES)
SQL["cluster_sizes"] = f"WITH {LABELLED} SELECT prediction, count(*) AS count FROM labelled GROUP BY prediction"
SQL["kmeans_centers"] = f"""WITH {LABELLED}
SELECT prediction, {', '.join(f'round(avg({f}), 6) AS {f}' for f in FEATURE_NAMES)}
FROM labelled GROUP BY prediction"""


def _gap(a: str, b: str) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in FEATURE_NAMES)


SQL["kmeans_assign"] = f"""WITH {LABELLED},
means AS (SELECT prediction, {_MEANS} FROM labelled GROUP BY prediction),
ranked AS (
  SELECT x.id, m.prediction,
         row_number() OVER (PARTITION BY x.id ORDER BY {_gap('x', 'm')}, m.prediction) AS place
  FROM labelled x, means m)
SELECT id, prediction FROM ranked WHERE place = 1"""
SQL["silhouette"] = f"""WITH {LABELLED},
sizes AS (SELECT prediction, count(*) AS n FROM labelled GROUP BY prediction),
sums AS (
  SELECT x.id, x.prediction AS mine, y.prediction AS other, sum({_gap('x', 'y')}) AS total
  FROM labelled x, labelled y GROUP BY x.id, x.prediction, y.prediction),
parts AS (
  SELECT id,
         max(CASE WHEN mine = other THEN total / (n - 1) END) AS inside,
         min(CASE WHEN mine <> other THEN total / n END) AS outside
  FROM sums JOIN sizes ON sizes.prediction = sums.other GROUP BY id)
SELECT round(avg((outside - inside) / greatest(outside, inside)), 6) AS silhouette FROM parts"""



def _steps(updates: int) -> str:
    """Centres of k = 2..8 after some updates from the rows of the smallest ids; ``assigned<i>`` are the rows by centre i."""
    features = ", ".join(FEATURE_NAMES)
    parts = [
        f"firsts AS (SELECT row_number() OVER (ORDER BY id) - 1 AS prediction, {features} FROM labelled ORDER BY id LIMIT 8)",
        f"centers0 AS (SELECT CAST(k AS INTEGER) AS k, prediction, {features} FROM firsts, range(2, 9) r(k) WHERE prediction < k)",
    ]
    for i in range(updates + 1):
        parts.append(f"""assigned{i} AS (
  SELECT x.*, c.k, c.prediction AS center FROM labelled x, centers{i} c
  QUALIFY row_number() OVER (PARTITION BY x.id, c.k ORDER BY {_gap('x', 'c')}, c.prediction) = 1)""")
        if i < updates:
            kept = ", ".join(f"coalesce(m.{f}, c.{f}) AS {f}" for f in FEATURE_NAMES)
            parts.append(f"""means{i} AS (SELECT k, center, {_MEANS} FROM assigned{i} GROUP BY k, center),
centers{i + 1} AS (SELECT c.k, c.prediction, {kept} FROM centers{i} c LEFT JOIN means{i} m ON m.k = c.k AND m.center = c.prediction)""")
    return ", ".join(parts)


SQL["kmeans_step"] = f"""WITH {LABELLED}, {_steps(3)}
SELECT k, prediction, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURE_NAMES)} FROM centers3"""
SQL["kmeans_step_silhouettes"] = f"""WITH {LABELLED}, {_steps(3)},
sizes AS (SELECT k, center, count(*) AS n FROM assigned3 GROUP BY k, center),
sums AS (
  SELECT x.k, x.id, x.center AS mine, y.center AS other, sum({_gap('x', 'y')}) AS total
  FROM assigned3 x JOIN assigned3 y ON x.k = y.k GROUP BY x.k, x.id, x.center, y.center),
parts AS (
  SELECT s.k, id,
         max(CASE WHEN mine = other THEN n END) AS own,
         max(CASE WHEN mine = other AND n > 1 THEN total / (n - 1) END) AS inside,
         min(CASE WHEN mine <> other THEN total / n END) AS outside
  FROM sums s JOIN sizes z ON z.k = s.k AND z.center = s.other GROUP BY s.k, id)
SELECT k, round(avg(CASE WHEN own = 1 THEN 0 ELSE (outside - inside) / greatest(outside, inside) END), 6) AS silhouette
FROM parts GROUP BY k"""

# ---- nearest neighbours ----


def _hash(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || id), 1, 8) AS BIGINT)"


SPLIT = f"""split AS (
  SELECT *, CASE WHEN {_hash(0)} < 3221225472 THEN 'train' ELSE 'test' END AS part FROM labelled)"""
SQL["holdout_split"] = f"WITH {LABELLED}, {SPLIT} SELECT id, part FROM split"


def _ranked(queries: str, rows: str, condition: str, k: int, extra: str = "") -> str:
    """Neighbour list of every query row, by brute force."""
    return f"""pairs AS (
  SELECT x.id, {extra} y.id AS neighborId, y.prediction AS neighborLabel, sqrt({_gap('x', 'y')}) AS dist
  FROM {queries} x JOIN {rows} y ON {condition}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighborId) AS rank FROM pairs
  QUALIFY rank <= {k}),
votes AS (
  SELECT *, CASE WHEN min(dist) OVER (PARTITION BY id) = 0 THEN CASE WHEN dist = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                 ELSE 1 / dist END AS weight
  FROM ranked)"""


TEST_VOTES = f"{LABELLED}, {SPLIT}, " + _ranked(
    "(SELECT * FROM split WHERE part = 'test')", "(SELECT * FROM split WHERE part = 'train')", "true", 36
)
SHARES = f"""{TEST_VOTES},
shares AS (
  SELECT id, neighborLabel AS Class, sum(weight) / any_value(total) AS Prob
  FROM (SELECT *, sum(weight) OVER (PARTITION BY id) AS total FROM votes) t
  GROUP BY id, neighborLabel HAVING sum(weight) > 0)"""
WINNERS = f"""{SHARES},
winners AS (
  SELECT id, Class AS Prediction, max(Prob) OVER (PARTITION BY id) AS Probability,
         row_number() OVER (PARTITION BY id ORDER BY round(Prob, 12) DESC, Class) AS place
  FROM shares QUALIFY place = 1)"""
IDENTITY = "'10.0.0.' || (id % 20) AS srcAddr, 100 + id % 3 AS vlanID"

SQL["knn_neighbors"] = f"""WITH {TEST_VOTES}
SELECT id, rank, neighborId, neighborLabel, round(dist, 6) AS dist FROM ranked"""
SQL["knn_class_prob"] = f"WITH {SHARES} SELECT id, Class, round(Prob, 6) AS Prob FROM shares"
SQL["knn_neighbors_cells"], SQL["knn_class_prob_cells"] = SQL["knn_neighbors"], SQL["knn_class_prob"]
SQL["knn_predict"] = f"""WITH {WINNERS}
SELECT id, Prediction, round(Probability, 6) AS Probability FROM winners"""
_WIDE = ", ".join(f"coalesce(max(CASE WHEN Class = {c} THEN Prob END), 0) AS p{c}" for c in range(8))
SQL["knn_prob_wide"] = f"""WITH {SHARES}
SELECT id, {', '.join(f'round(p{c}, 6) AS p{c}' for c in range(8))}
FROM (SELECT id, {_WIDE} FROM shares GROUP BY id) wide"""
SQL["knn_prob_array"] = f"""WITH {SHARES}
SELECT id, {" || ',' || ".join(f'CAST(round(p{c} * 1000000) AS BIGINT)' for c in range(8))} AS millionths
FROM (SELECT id, {_WIDE} FROM shares GROUP BY id) wide"""
SQL["knn_second_class_prob"] = f"""WITH {SHARES}
SELECT id, round(p1, 6) AS probability FROM (SELECT id, {_WIDE} FROM shares GROUP BY id) wide"""

# ---- verdicts ----

SQL["anomaly_verdict"] = f"""WITH {SHARES}
SELECT id, {IDENTITY}, Class, round(Prob, 6) AS Prob FROM shares WHERE Prob > 0 AND Class IN (2, 3, 6, 7)"""
SQL["anomaly_verdict_strict"] = f"""WITH {WINNERS}
SELECT id, {IDENTITY}, Prediction, round(Probability, 6) AS Probability
FROM winners WHERE Prediction IN (2, 3, 6, 7) OR Probability < 0.99"""
SQL["anomaly_pairs"] = f"""WITH {SHARES}
SELECT DISTINCT {IDENTITY} FROM shares WHERE Prob > 0 AND Class IN (2, 3, 6, 7)"""
SQL["mitigation_actions"] = f"""WITH {SHARES}
SELECT DISTINCT CAST(json_object('srcAddr', '10.0.0.' || (id % 20), 'vlanID', 100 + id % 3) AS VARCHAR) AS action
FROM shares WHERE Prob > 0 AND Class IN (2, 3, 6, 7)"""
_NORMAL = """SELECT DISTINCT w.Prediction AS label FROM winners w JOIN split s ON s.id = w.id
  WHERE s.sumOfFlows < -0.1 AND s.prediction NOT IN (2, 3, 6, 7)"""
SQL["normal_labels"] = f"WITH {WINNERS} {_NORMAL}"
SQL["anomalous_labels"] = f"""WITH {WINNERS}
SELECT DISTINCT prediction AS label FROM labelled WHERE prediction NOT IN ({_NORMAL})"""

PROFILE_SHARES = f"""{LINE_FEATURES}, numbered AS (
  SELECT *, windowStart // {WIDTH} * 100000000 + CAST(substr(srcAddr, 8) AS BIGINT) * 1000 + vlanID AS id,
         least(CAST(floor(sumOfFlows / 8) AS BIGINT), 7) AS prediction
  FROM line_features), """ + _ranked(
    f"(SELECT * FROM numbered WHERE windowStart // {WIDTH} % 2 = 1)",
    f"(SELECT * FROM numbered WHERE windowStart // {WIDTH} % 2 = 0)",
    "true",
    36,
) + """,
shares AS (
  SELECT id, neighborLabel AS Class, sum(weight) / any_value(total) AS Prob
  FROM (SELECT *, sum(weight) OVER (PARTITION BY id) AS total FROM votes) t
  GROUP BY id, neighborLabel HAVING sum(weight) > 0)"""
SQL["profile_verdict"] = f"""WITH {PROFILE_SHARES}
SELECT n.windowStart, n.srcAddr, n.vlanID, s.Class, round(s.Prob, 6) AS Prob
FROM shares s JOIN numbered n ON n.id = s.id WHERE s.Class IN (2, 3, 6, 7)"""

_INVERSE = ", ".join(f"1 / stddev_samp({f}) AS d_{f}" for f in FEATURE_NAMES)
_TIMES = ", ".join(f"{f} * d_{f} AS {f}" for f in FEATURE_NAMES)
STORED = f"""{LINE_FEATURES}, banded AS (
  SELECT windowStart // {WIDTH} * 100000000 + CAST(substr(srcAddr, 8) AS BIGINT) * 1000 + vlanID AS id, windowStart, srcAddr, vlanID,
         least(CAST(floor(sumOfFlows / 8) AS BIGINT), 7) AS prediction, sumOfFlows <= 24 AS quiet, {', '.join(FEATURE_NAMES)}
  FROM line_features),
inverse AS (SELECT {_INVERSE} FROM banded WHERE windowStart // {WIDTH} % 2 = 0),
scaled AS (SELECT id, windowStart, srcAddr, vlanID, prediction, quiet, {_TIMES} FROM banded, inverse), """ + _ranked(
    f"(SELECT * FROM scaled WHERE windowStart // {WIDTH} % 2 = 1 OR quiet)",
    f"(SELECT * FROM scaled WHERE windowStart // {WIDTH} % 2 = 0)",
    "true",
    36,
) + f""",
shares AS (
  SELECT id, neighborLabel AS Class, sum(weight) / any_value(total) AS Prob
  FROM (SELECT *, sum(weight) OVER (PARTITION BY id) AS total FROM votes) t
  GROUP BY id, neighborLabel HAVING sum(weight) > 0),
met AS (
  SELECT DISTINCT Class FROM (
    SELECT s.id, Class FROM shares s JOIN scaled x ON x.id = s.id WHERE x.windowStart // {WIDTH} % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(Prob, 12) DESC, Class) = 1) w),
scores AS (
  SELECT windowStart, srcAddr, vlanID, Class, Prob
  FROM shares s JOIN scaled x ON x.id = s.id WHERE windowStart // {WIDTH} % 2 = 1)"""
SQL["stored_model_scores"] = f"WITH {STORED} SELECT windowStart, srcAddr, vlanID, Class, round(Prob, 6) AS Prob FROM scores"
SQL["stored_model_pairs"] = f"""WITH {STORED}
SELECT DISTINCT srcAddr, vlanID FROM scores WHERE Class NOT IN (SELECT Class FROM met)"""

SQL["detected_stream_pairs"] = f"""WITH {STORED}
SELECT DISTINCT srcAddr, vlanID FROM scores WHERE windowStart = 107 * {WIDTH} AND Class NOT IN (SELECT Class FROM met)"""

# ---- tuning ----

FOLDED = f"""{LABELLED}, folded AS (
  SELECT *, (row_number() OVER (PARTITION BY prediction ORDER BY id) - 1) % 10 AS fold FROM labelled)"""
SHUFFLED = f"{LABELLED}, shuffled AS (SELECT *, {_hash(7)} % 10 AS fold FROM labelled)"


def _curve(votes: str) -> str:
    """Winner per row and k, from running class weights."""
    return f"""{votes},
running AS (
  SELECT *, sum(weight) OVER (PARTITION BY id, neighborLabel ORDER BY rank) AS held FROM votes),
leaders AS (
  SELECT a.id, a.truth, a.fold, b.rank AS k,
         arg_max(a.neighborLabel, {{'held': a.held, 'label': -a.neighborLabel}}) AS guess
  FROM running a JOIN running b ON a.id = b.id AND a.rank <= b.rank
  GROUP BY a.id, a.truth, a.fold, b.rank)"""


_TRUTH = "x.prediction AS truth, 0 AS fold,"
_TRUTH_FOLD = "x.prediction AS truth, x.fold AS fold,"
CV_CURVE = _curve(
    f"{FOLDED}, " + _ranked("folded", "folded", "x.fold <> y.fold", 40, _TRUTH_FOLD)
) + """, cv_curve AS (
  SELECT k, round(avg(accuracy), 6) AS accuracy
  FROM (SELECT k, fold, avg(CAST(guess = truth AS DOUBLE)) AS accuracy FROM leaders GROUP BY k, fold) f
  GROUP BY k)"""
HOLDOUT_CURVE = _curve(
    f"{LABELLED}, {SPLIT}, "
    + _ranked(
        "(SELECT * FROM split WHERE part = 'test')", "(SELECT * FROM split WHERE part = 'train')", "true", 39, _TRUTH
    )
) + """, holdout_curve AS (
  SELECT k, round(avg(CAST(guess <> truth AS DOUBLE)), 6) AS error,
         round(avg(CAST(guess = truth AS DOUBLE)), 6) AS accuracy
  FROM leaders GROUP BY k)"""

SQL["profile_verdict_cells"] = SQL["profile_verdict"]
SQL["knn_neighbors_apart_cells"] = f"WITH {FOLDED}, " + _ranked("folded", "folded", "x.fold <> y.fold", 36) + """
SELECT id, rank, neighborId, round(dist, 6) AS dist FROM ranked"""
SQL["stratified_folds"] = f"WITH {FOLDED} SELECT id, prediction, fold FROM folded"
SQL["knn_cv_curve"] = f"WITH {CV_CURVE} SELECT k, accuracy FROM cv_curve"
SQL["best_k"] = f"WITH {CV_CURVE} SELECT k, accuracy FROM cv_curve ORDER BY accuracy DESC, k LIMIT 1"
SQL["knn_error_curve"] = f"WITH {HOLDOUT_CURVE} SELECT k, error FROM holdout_curve"
SQL["knn_accuracy_curve"] = f"WITH {HOLDOUT_CURVE} SELECT k, accuracy FROM holdout_curve"
SQL["knn_holdout_accuracy"] = f"WITH {HOLDOUT_CURVE} SELECT k, accuracy FROM holdout_curve WHERE k = 36"

# ---- classifier comparison ----

KNN_FOLDS = f"""{SHUFFLED}, {_ranked("shuffled", "shuffled", "x.fold <> y.fold", 5, _TRUTH_FOLD)},
counts AS (
  SELECT id, truth, fold, neighborLabel, count(*) AS n FROM ranked GROUP BY ALL),
guesses AS (
  SELECT id, truth, fold, neighborLabel AS guess,
         row_number() OVER (PARTITION BY id ORDER BY n DESC, neighborLabel) AS place
  FROM counts QUALIFY place = 1),
knn_folds AS (
  SELECT 'KNN' AS model, fold, avg(CAST(guess = truth AS DOUBLE)) AS accuracy FROM guesses GROUP BY fold)"""
SQL["clf_knn"] = f"WITH {KNN_FOLDS} SELECT model, fold, round(accuracy, 6) AS accuracy FROM knn_folds"
SQL["fold_spread"] = f"""WITH {KNN_FOLDS}
SELECT model, round(min(accuracy), 6) AS low, round(quantile_cont(accuracy, 0.25), 6) AS q1,
       round(quantile_cont(accuracy, 0.5), 6) AS median, round(quantile_cont(accuracy, 0.75), 6) AS q3,
       round(max(accuracy), 6) AS high
FROM knn_folds GROUP BY model"""

_STATS = ", ".join(f"avg(t.{f}) AS m_{f}, var_pop(t.{f}) AS v_{f}" for f in FEATURE_NAMES)
_WIDEST = "greatest(" + ", ".join(f"var_pop(t.{f})" for f in FEATURE_NAMES) + ")"
_LIKELY = " ".join(
    f"- 0.5 * ln(v_{f} + eps) - 0.5 * (x.{f} - m_{f}) * (x.{f} - m_{f}) / (v_{f} + eps)" for f in FEATURE_NAMES
)
SQL["clf_nb"] = f"""WITH {SHUFFLED},
folds AS (SELECT DISTINCT fold FROM shuffled),
widest AS (
  SELECT f.fold, 1e-9 * {_WIDEST} AS eps FROM folds f JOIN shuffled t ON t.fold <> f.fold GROUP BY f.fold),
stats AS (
  SELECT f.fold, t.prediction AS guess, count(*) AS n, {_STATS}
  FROM folds f JOIN shuffled t ON t.fold <> f.fold GROUP BY f.fold, t.prediction),
scored AS (
  SELECT x.id, x.fold, x.prediction, s.guess, ln(s.n) {_LIKELY} AS score
  FROM shuffled x JOIN stats s ON s.fold = x.fold JOIN widest w ON w.fold = x.fold),
best AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, guess) AS place FROM scored QUALIFY place = 1)
SELECT 'NB' AS model, fold, round(avg(CAST(guess = prediction AS DOUBLE)), 6) AS accuracy FROM best GROUP BY fold"""



def _discriminant() -> str:
    """Linear scores of every fold's classes: the pooled covariance and the class means, solved by elimination.

    ``system<k>`` is the matrix with the class means beside it after k steps; it is symmetric and positive, so
    no rows are swapped.
    """
    long = " UNION ALL ".join(f"SELECT id, fold, prediction, {i} AS i, {f} AS v FROM shuffled" for i, f in enumerate(FEATURE_NAMES))
    parts = [
        f"long AS ({long})",
        "folds AS (SELECT DISTINCT fold AS tree FROM shuffled)",
        """means AS (SELECT tree, prediction, i, avg(v) AS mean FROM folds JOIN long ON fold <> tree GROUP BY ALL)""",
        """sizes AS (SELECT tree, prediction, count(*) AS n, sum(count(*)) OVER (PARTITION BY tree) AS total,
         count(*) OVER (PARTITION BY tree) AS classes FROM folds JOIN shuffled ON fold <> tree GROUP BY tree, prediction)""",
        """away AS (SELECT tree, id, l.prediction, l.i, v - mean AS d FROM folds JOIN long l ON fold <> tree JOIN means m USING (tree, prediction, i))""",
        """spread AS (
  SELECT a.tree, a.i, b.i AS j, sum(a.d * b.d) / any_value(total - classes) AS v
  FROM away a JOIN away b ON a.tree = b.tree AND a.id = b.id JOIN sizes s ON s.tree = a.tree AND s.prediction = a.prediction
  GROUP BY a.tree, a.i, b.i)""",
        "system0 AS (SELECT tree, i, j, v FROM spread UNION ALL SELECT tree, i, 100 + prediction, mean FROM means)",
    ]
    for k in range(len(FEATURE_NAMES)):
        parts.append(f"""system{k + 1} AS (
  SELECT x.tree, x.i, x.j, CASE WHEN x.i = {k} THEN x.v / d.v ELSE x.v - b.v / d.v * a.v END AS v
  FROM system{k} x JOIN system{k} d ON d.tree = x.tree AND d.i = {k} AND d.j = {k}
  JOIN system{k} a ON a.tree = x.tree AND a.i = {k} AND a.j = x.j
  JOIN system{k} b ON b.tree = x.tree AND b.i = x.i AND b.j = {k})""")
    last = len(FEATURE_NAMES)
    parts.append(f"slopes AS (SELECT tree, i, j - 100 AS prediction, v AS slope FROM system{last} WHERE j >= 100)")
    parts.append("""constants AS (
  SELECT tree, prediction, ln(any_value(n) / any_value(total)) - 0.5 * sum(mean * slope) AS constant
  FROM slopes JOIN means USING (tree, prediction, i) JOIN sizes USING (tree, prediction) GROUP BY tree, prediction)""")
    return ", ".join(parts)


SQL["clf_lda"] = f"""WITH {SHUFFLED}, {_discriminant()},
scored AS (
  SELECT l.id, l.fold, l.prediction AS truth, s.prediction AS guess, any_value(constant) + sum(v * slope) AS score
  FROM long l JOIN slopes s ON s.tree = l.fold AND s.i = l.i JOIN constants c ON c.tree = s.tree AND c.prediction = s.prediction
  GROUP BY l.id, l.fold, l.prediction, s.prediction),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, guess) = 1)
SELECT 'LDA' AS model, fold, round(avg(CAST(guess = truth AS DOUBLE)), 6) AS accuracy FROM best GROUP BY fold"""
SQL["model_summary"] = f"""SELECT model, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM (
  ({SQL['clf_knn'].replace('round(accuracy, 6)', 'accuracy')}) UNION ALL
  ({SQL['clf_lda'].replace('round(avg(CAST(guess = truth AS DOUBLE)), 6)', 'avg(CAST(guess = truth AS DOUBLE))')}) UNION ALL
  ({SQL['clf_nb'].replace('round(avg(CAST(guess = prediction AS DOUBLE)), 6)', 'avg(CAST(guess = prediction AS DOUBLE))')})) s GROUP BY model"""


def _trees(depth: int, bins: int) -> str:
    """Gini trees of all folds, each grown from the other folds; ``at<level>`` places every row in every tree."""
    bounds = ", ".join(f"min({f}) AS a{i}, max({f}) AS b{i}" for i, f in enumerate(FEATURE_NAMES))
    values = " UNION ALL ".join(f"SELECT id, {i} AS f, {f} AS v, a{i} AS a, b{i} AS b FROM shuffled, bounds" for i, f in enumerate(FEATURE_NAMES))
    parts = [
        f"bounds AS (SELECT {bounds} FROM shuffled)",
        f"valued AS ({values})",
        f"binned AS (SELECT id, f, v, (SELECT count(*) FROM range(1, {bins}) r(j) WHERE a + (b - a) * j / {bins} <= v) AS bin FROM valued)",
        f"""edges AS (
  SELECT f, j - 1 AS bin, a + (b - a) * j / {bins} AS threshold FROM (SELECT DISTINCT f, a, b FROM valued), range(1, {bins}) r(j))""",
        "at0 AS (SELECT t.fold AS tree, 0 AS node, id, x.fold, prediction FROM shuffled x, (SELECT DISTINCT fold FROM shuffled) t)",
    ]
    for level in range(depth + 1):
        parts.append(f"""classes{level} AS (
  SELECT tree, node, prediction, count(*) AS n FROM at{level} WHERE fold <> tree GROUP BY ALL),
nodes{level} AS (
  SELECT tree, node, sum(n)::BIGINT AS n, sum(n * n)::BIGINT AS squares, arg_max(prediction, {{'n': n, 'p': -prediction}}) AS prediction
  FROM classes{level} GROUP BY tree, node)""")
        if level == depth:
            break
        parts.append(f"""counted{level} AS (
  SELECT tree, node, f, bin, prediction, count(*) AS n FROM at{level} JOIN binned USING (id) WHERE fold <> tree GROUP BY ALL),
lefts{level} AS (
  SELECT c.tree, c.node, c.f, e.bin, c.prediction, sum(c.n) FILTER (c.bin <= e.bin) AS l, sum(c.n) AS n
  FROM counted{level} c JOIN edges e ON e.f = c.f GROUP BY ALL),
sides{level} AS (
  SELECT tree, node, f, bin, sum(coalesce(l, 0)) AS nl, sum(coalesce(l, 0) * coalesce(l, 0)) AS sl,
         sum(n - coalesce(l, 0)) AS nr, sum((n - coalesce(l, 0)) * (n - coalesce(l, 0))) AS sr
  FROM lefts{level} GROUP BY tree, node, f, bin),
pures{level} AS (
  SELECT tree, node, f, bin, sl::DOUBLE / nl::DOUBLE + sr::DOUBLE / nr::DOUBLE AS pure FROM sides{level} WHERE nl > 0 AND nr > 0
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY pure DESC, f, bin) = 1),
splits{level} AS (
  SELECT p.tree, p.node, p.f, p.bin, threshold FROM pures{level} p JOIN nodes{level} n USING (tree, node) JOIN edges e ON e.f = p.f AND e.bin = p.bin
  WHERE pure > n.squares::DOUBLE / n.n::DOUBLE + 1e-9),
at{level + 1} AS (
  SELECT x.tree, 2 * x.node + 1 + CAST(b.v >= s.threshold AS INTEGER) AS node, x.id, x.fold, x.prediction
  FROM at{level} x JOIN splits{level} s ON s.tree = x.tree AND s.node = x.node JOIN binned b ON b.id = x.id AND b.f = s.f)""")
    return ", ".join(parts)


_LEVELS = " UNION ALL ".join(
    [
        f"""SELECT n.tree, n.node, coalesce(s.f, -1) AS feature, coalesce(s.threshold, 0) AS threshold, n.n, n.prediction
FROM nodes{i} n LEFT JOIN splits{i} s ON s.tree = n.tree AND s.node = n.node"""
        for i in range(3)
    ]
    + ["SELECT tree, node, -1, 0, n, prediction FROM nodes3"]
)
TREES = f"{SHUFFLED}, {_trees(3, 32)}, tree_table AS ({_LEVELS})"
SQL["tree_nodes"] = f"""WITH {TREES}
SELECT tree, node, feature, round(threshold, 6) AS threshold, n, prediction FROM tree_table"""
SQL["tree_predictions"] = f"""WITH {TREES},
placed AS ({' UNION ALL '.join(f'SELECT id, fold, tree, node, {i} AS level FROM at{i}' for i in range(4))})
SELECT p.id, p.fold, t.prediction AS guess FROM placed p JOIN tree_table t ON t.tree = p.tree AND t.node = p.node
WHERE p.fold = p.tree QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY level DESC) = 1"""

# ---- streams ----

EVENT_SOURCE = SOURCE.format(flows="windowed")
SQL["stream_source_profile_whole"] = f"""WITH {EVENT_FLOWS},
windowed AS (SELECT *, timestampStart // 86400 * 86400 AS windowStart FROM event_flows), {EVENT_SOURCE}
SELECT * FROM source_rows"""
SQL["compacted_history"] = SQL["collected_history"]
SQL["stream_source_profile"] = f"""WITH {EVENT_FLOWS},
windowed AS (SELECT *, timestampStart // 86400 * 86400 AS windowStart FROM event_flows), {EVENT_SOURCE}
SELECT * FROM source_rows
WHERE windowStart + 86400 <= (SELECT max(timestampStart) - 3600 FROM event_flows)"""
