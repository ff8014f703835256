"""DuckDB SQL for every query of ``queries.QUERIES`` that SQL can express.

The stand-in tables are rebuilt here as CTEs over the driver's views, written
the plain way (global windows, theta joins): the oracle is the reference
form, the Spark plan is the scalable one.  Conventions: vectors cast to
``DOUBLE[]``; doubles rounded to 6 digits; hash draws are
``('0x' || substr(md5(x), 1, 8))::UBIGINT / 4294967296.0``.
"""

from __future__ import annotations

from ..functions.numeric import rnd_sql

# -- stand-in tables -------------------------------------------------------

VEC_PAIRS = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS emb, label FROM embeddings),
vec_pairs AS (
  SELECT a.vec_id AS pair_id, a.emb AS u, b.emb AS v, a.label AS label_a, b.label AS label_b,
         1.0::DOUBLE - abs(a.label - b.label) / 9.0::DOUBLE AS score, a.vec_id // 16 AS batch_id
  FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
"""


def cos_sql(u: str, v: str) -> str:
    return (
        f"(list_dot_product({u}, {v}) / (greatest(sqrt(list_dot_product({u}, {u})), 1e-6)"
        f" * greatest(sqrt(list_dot_product({v}, {v})), 1e-6)))"
    )


def pearson_sql(x: str, y: str) -> str:
    den = f"(stddev_pop({x}) * stddev_pop({y}))"
    return f"CASE WHEN {den} = 0 OR {den} IS NULL THEN NULL ELSE covar_pop({x}, {y}) / {den} END"


def rank2_sql(v: str, part: str) -> str:
    """Doubled average rank of ``v`` within ``part``."""
    return (
        f"(2 * rank() OVER (PARTITION BY {part} ORDER BY {v}) "
        f"+ count(*) OVER (PARTITION BY {part}, {v}) - 1)"
    )


STS_EVAL = f"""
WITH {VEC_PAIRS},
c AS (SELECT label_a AS label, score, {cos_sql('u', 'v')} AS cos FROM vec_pairs),
r AS (SELECT *, {rank2_sql('score', 'label')}::DOUBLE AS ry, {rank2_sql('cos', 'label')}::DOUBLE AS rp FROM c)
SELECT label, count(*) AS n,
       {rnd_sql('avg(pow(cos - score, 2))')} AS mse,
       {rnd_sql(pearson_sql('score', 'cos'))} AS pearson,
       {rnd_sql(pearson_sql('ry', 'rp'))} AS spearman
FROM r GROUP BY label
"""

ORACLES = {
    "sts_eval": STS_EVAL,
}


# -- helpers -----------------------------------------------------------------

from ..functions.numeric import fixed4_sql, rnd_sql as r6  # noqa: E402


def md5_sql(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + "))"


def unit_sql(*parts: str) -> str:
    return f"(('0x' || substr({md5_sql(*parts)}, 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def text_pairs_sql(name: str, modulus: int) -> str:
    return f"""{name} AS (
  SELECT a.doc_id AS pair_id, (a.n_chars % {modulus})::DOUBLE AS score, a.text AS text1, b.text AS text2
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


TURN_PAIRS = """turn_pairs AS (
  SELECT a.conv_id * 1000000 + a.turn AS pair_id, a.conv_id, a.turn, a.text AS text1, b.text AS text2
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def strata_sql(name: str, width: int) -> str:
    return f"{name} AS (SELECT doc_id, n_chars // {width} AS skey FROM documents)"


def split_sql(name: str, src: str, id_col: str, key: str, test_size: float, seed: str, first: str, second: str) -> str:
    """CTEs ending in ``name``: every row of ``src`` with a ``part`` column."""
    return f"""{name}_cls AS (SELECT {key} AS k, count(*) AS nc FROM {src} GROUP BY {key}),
{name}_tot AS (
  SELECT n, ceil({float(test_size)!r}::DOUBLE * n)::BIGINT AS ntest, n - ceil({float(test_size)!r}::DOUBLE * n)::BIGINT AS ntrain
  FROM (SELECT coalesce(sum(nc) FILTER (WHERE nc > 1), 0)::BIGINT AS n FROM {name}_cls)),
{name}_q AS (
  SELECT k, nc = 1 AS rare, ntrain,
         CASE WHEN nc = 1 THEN 0 ELSE (nc::HUGEINT * ntrain) // n END::BIGINT AS fl,
         CASE WHEN nc = 1 THEN -1 ELSE (nc::HUGEINT * ntrain) % n END::BIGINT AS rem
  FROM {name}_cls, {name}_tot),
{name}_q2 AS (
  SELECT *, row_number() OVER (ORDER BY -rem, {md5_sql(repr(seed), 'k')}) AS rpos, sum(fl) OVER () AS sf FROM {name}_q),
{name}_q3 AS (
  SELECT k, rare, fl + CASE WHEN NOT rare AND rpos <= ntrain - sf THEN 1 ELSE 0 END AS quota FROM {name}_q2),
{name}_r AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.{key} ORDER BY {md5_sql(repr(seed), 's.' + id_col)}, s.{id_col}) AS kpos
  FROM {src} s),
{name} AS (
  SELECT r.* EXCLUDE (kpos), CASE WHEN NOT q.rare AND r.kpos <= q.quota THEN '{first}' ELSE '{second}' END AS part
  FROM {name}_r r JOIN {name}_q3 q ON r.{key} IS NOT DISTINCT FROM q.k)"""


def numbered_sql(src: str, id_col: str) -> str:
    """Rows with ``_x`` (0-based position in id order), ``_n`` and the two bases of the bijection."""
    return f"""(SELECT *, (_n + _a - 1) // _a AS _b FROM (SELECT *, ceil(sqrt(_n))::BIGINT AS _a FROM
    (SELECT *, row_number() OVER (ORDER BY {id_col}) - 1 AS _x, count(*) OVER () AS _n FROM {src})))"""


def perm_sql(seed: str, salt: str) -> str:
    """The 1-based image of ``_x``: four rounds, walked on until below ``_n``."""
    h = lambda digit: f"('0x' || substr({md5_sql(repr(seed), repr(salt), 'i', digit)}, 1, 8))::UBIGINT::BIGINT"
    trip = lambda x: (f"list_reduce(list_prepend({x}, [1, 2, 3, 4]::BIGINT[]), lambda v, i: CASE WHEN i % 2 = 1 "  # noqa: E731
                      f"THEN ((v // _b + {h('v % _b')}) % _a) * _b + v % _b ELSE (v // _b) * _b + (v % _b + {h('v // _b')}) % _b END)")
    return f"(1 + list_reduce(list_prepend({trip('_x')}, range(1, 65)), lambda x, j: CASE WHEN x < _n THEN x ELSE {trip('x')} END))"


def negatives_sql(src: str, seed: str = "42") -> str:
    return f"""rec AS (SELECT * EXCLUDE (_x, _n, _a, _b), {perm_sql(seed, 'a')} AS ra,
                1 + (('0x' || substr({md5_sql(repr(seed), "'c'", 'pair_id')}, 1, 8))::UBIGINT % 2)::INTEGER AS side FROM {numbered_sql(src, 'pair_id')}),
don AS (SELECT pair_id AS donor_id, text1 AS d1, text2 AS d2, row_number() OVER (ORDER BY pair_id) AS rb FROM {src}),
neg AS (SELECT rec.*, don.donor_id, CASE WHEN side = 1 THEN d1 ELSE d2 END AS sentence3 FROM rec JOIN don ON ra = rb)"""


# -- queries -------------------------------------------------------------------

ORACLES.update({
    "score_normalise": f"""
WITH {text_pairs_sql('ro', 6)}, {text_pairs_sql('bib', 101)}
SELECT 'ro-sts' AS dataset, pair_id, text1 AS sentence1, text2 AS sentence2, NULL::VARCHAR AS sentence3,
       {r6('score / 5.0::DOUBLE')} AS sim FROM ro
UNION ALL
SELECT 'biblical_01', pair_id, text1, text2, NULL::VARCHAR, {r6('score / 100.0::DOUBLE')} FROM bib
""",
    "split_chain": f"""
WITH {strata_sql('st', 50)},
{split_sql('s1', 'st', 'doc_id', 'skey', 0.1, '42-1', 'discard', 'keep')},
k1 AS (SELECT doc_id, skey FROM s1 WHERE part = 'keep'),
{split_sql('s2', 'k1', 'doc_id', 'skey', 0.3, '42-2', 'train', 'temp')},
k2 AS (SELECT doc_id, skey FROM s2 WHERE part = 'temp'),
{split_sql('s3', 'k2', 'doc_id', 'skey', 0.5, '42-3', 'dev', 'test')}
SELECT doc_id, skey, part FROM s1 WHERE part = 'discard'
UNION ALL SELECT doc_id, skey, part FROM s2 WHERE part = 'train'
UNION ALL SELECT doc_id, skey, part FROM s3
""",
    "stratified_split": f"""
WITH {strata_sql('st', 1)},
{split_sql('s1', 'st', 'doc_id', 'skey', 0.3, '42', 'train', 'test')}
SELECT doc_id, skey, part FROM s1
""",
    "key_semi_anti": f"""
WITH {strata_sql('st', 50)},
c AS (SELECT skey, count(*) AS n FROM st GROUP BY skey)
SELECT st.doc_id, st.skey, CASE WHEN c.n = 1 THEN 'rare' ELSE 'common' END AS kind
FROM st JOIN c ON st.skey IS NOT DISTINCT FROM c.skey
""",
    "negatives_pair": f"""
WITH {text_pairs_sql('tp', 6)}, {negatives_sql('tp')}
SELECT pair_id, donor_id, side, text1 AS sentence1, text2 AS sentence2, sentence3, {r6('score / 5.0::DOUBLE')} AS sim FROM neg
""",
    "negatives_triplet": f"""
WITH {TURN_PAIRS}, {negatives_sql('turn_pairs')}
SELECT pair_id, donor_id, side, text1 AS sentence1, text2 AS sentence2, sentence3 FROM neg
""",
    "batches": f"""
WITH d AS (SELECT doc_id FROM documents),
s0 AS (SELECT doc_id, {perm_sql('42', 'epoch-0')} AS p FROM {numbered_sql('d', 'doc_id')}),
s1 AS (SELECT doc_id, {perm_sql('42', 'epoch-1')} AS p FROM {numbered_sql('d', 'doc_id')}),
sq AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM d)
SELECT 'shuffled-0' AS kind, doc_id, (p - 1) // 16 AS batch_id, (p - 1) % 16 AS batch_idx FROM s0
UNION ALL SELECT 'shuffled-1', doc_id, (p - 1) // 16, (p - 1) % 16 FROM s1
UNION ALL SELECT 'sequential', doc_id, (p - 1) // 16, (p - 1) % 16 FROM sq
""",
    "row_lookup": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, doc_id, lang, n_chars FROM documents
""",
    "pearson_by_stage": f"""
SELECT l_returnflag AS stage, count(*) AS n, {r6(pearson_sql('l_quantity', 'l_extendedprice'))} AS pearson
FROM lineitem GROUP BY l_returnflag
""",
    "spearman_by_stage": f"""
WITH r AS (SELECT l_returnflag AS stage,
   {rank2_sql('l_quantity', 'l_returnflag')}::DOUBLE AS ry,
   {rank2_sql('l_extendedprice', 'l_returnflag')}::DOUBLE AS rp FROM lineitem)
SELECT stage, count(*) AS n, {r6(pearson_sql('ry', 'rp'))} AS spearman FROM r GROUP BY stage
""",
    "mean_batch_loss": f"""
WITH p AS (SELECT l_returnflag AS stage, l_orderkey // 64 AS batch_id,
                  pow(l_extendedprice / 105000.0::DOUBLE - l_quantity / 50.0::DOUBLE, 2) AS loss FROM lineitem),
b AS (SELECT stage, batch_id, avg(loss) AS bl FROM p GROUP BY stage, batch_id)
SELECT stage, count(*) AS n_batches, {r6('avg(bl)')} AS avg_loss FROM b GROUP BY stage
""",
})
ORACLES["split_counts"] = "WITH x AS (" + ORACLES["split_chain"] + ") SELECT part, count(*) AS n FROM x GROUP BY part"


# -- vector losses ----------------------------------------------------------------

def nrm(x: str) -> str:
    return f"sqrt(list_dot_product({x}, {x}))"


def ncos_sql(u: str, v: str) -> str:
    """Cosine of the L2-normalised vectors (eps 1e-12)."""
    return f"(list_dot_product({u}, {v}) / (greatest({nrm(u)}, 1e-12) * greatest({nrm(v)}, 1e-12)))"


def angle_sql(u: str, v: str, tau: float = 20.0) -> str:
    a, b = f"list_slice({u}, 1, len({u}) // 2)", f"list_slice({u}, len({u}) // 2 + 1, len({u}))"
    c, d = f"list_slice({v}, 1, len({v}) // 2)", f"list_slice({v}, len({v}) // 2 + 1, len({v}))"
    num = f"(list_dot_product({a}, {c}) + list_dot_product({b}, {d}) + list_dot_product({b}, {c}) - list_dot_product({a}, {d}))"
    return f"({tau}::DOUBLE * abs({num} / ({nrm(u)} * {nrm(v)})))"


def dist_sql(u: str, v: str) -> str:
    return f"sqrt(list_sum(list_transform(generate_series(1, len({u})), lambda i: pow({u}[i] - {v}[i] + 1e-6::DOUBLE, 2))))"


def ranking_ctes(score_expr: str, name: str = "rk") -> str:
    """Theta-join form of the ranking loss per batch, unrounded, as CTEs
    ending in ``name(batch_id, loss)``; needs ``vec_pairs``."""
    return f"""{name}_c AS (SELECT batch_id, score, {score_expr} AS s FROM vec_pairs),
{name}_b AS (SELECT DISTINCT batch_id FROM {name}_c),
{name}_t AS (SELECT a.batch_id, sum(exp(a.s - z.s)) AS e FROM {name}_c a JOIN {name}_c z
             ON a.batch_id = z.batch_id AND a.score < z.score GROUP BY a.batch_id),
{name} AS (SELECT b.batch_id, ln(1 + coalesce(t.e, 0)) AS loss FROM {name}_b b LEFT JOIN {name}_t t ON b.batch_id = t.batch_id)"""


def ranking_sql(score_expr: str) -> str:
    return f"WITH {VEC_PAIRS}, {ranking_ctes(score_expr)} SELECT batch_id, {r6('loss')} AS loss FROM rk"


IN_BATCH = f"""{VEC_PAIRS},
z AS (SELECT batch_id, pair_id, 1 AS side, u AS x, score FROM vec_pairs
      UNION ALL SELECT batch_id, pair_id, 2 AS side, v AS x, score FROM vec_pairs),
zn AS (SELECT *, list_transform(x, lambda e: e / greatest({nrm('x')}, 1e-12)) AS xn FROM z),
pr AS (SELECT a.batch_id, a.pair_id, a.side, a.score, 20.0::DOUBLE * list_dot_product(a.xn, b.xn) AS logit,
              a.pair_id = b.pair_id AS is_partner, list_dot_product(a.xn, b.xn) AS sim
       FROM zn a JOIN zn b ON a.batch_id = b.batch_id AND NOT (a.pair_id = b.pair_id AND a.side = b.side)),
mx AS (SELECT batch_id, pair_id, side, max(logit) AS m FROM pr GROUP BY ALL),
rows AS (SELECT pr.batch_id, pr.pair_id, pr.side, any_value(pr.score) AS score,
                mx.m + ln(sum(exp(pr.logit - mx.m))) AS lse, max(pr.sim) FILTER (WHERE pr.is_partner) AS partner_sim
         FROM pr JOIN mx USING (batch_id, pair_id, side) GROUP BY pr.batch_id, pr.pair_id, pr.side, mx.m),
ce AS (SELECT *, CASE WHEN floor(score) = 1 THEN lse - 20.0::DOUBLE * partner_sim ELSE 0.0::DOUBLE END AS ce FROM rows)"""


def vec_negatives_sql(seed: str = "42") -> str:
    return f"""rec AS (SELECT * EXCLUDE (_x, _n, _a, _b), {perm_sql(seed, 'a')} AS ra,
                1 + (('0x' || substr({md5_sql(repr(seed), "'c'", 'pair_id')}, 1, 8))::UBIGINT % 2)::INTEGER AS side
         FROM {numbered_sql('vec_pairs', 'pair_id')}),
don AS (SELECT u AS du, v AS dv, row_number() OVER (ORDER BY pair_id) AS rb FROM vec_pairs),
neg AS (SELECT rec.*, CASE WHEN side = 1 THEN du ELSE dv END AS w FROM rec JOIN don ON ra = rb)"""


ORACLES.update({
    "theta_pairs": f"""
WITH {VEC_PAIRS}
SELECT l.batch_id, l.pair_id,
       count(*) FILTER (WHERE r.score < l.score) AS n_lower,
       count(*) FILTER (WHERE r.score > l.score) AS n_higher
FROM vec_pairs l JOIN vec_pairs r ON l.batch_id = r.batch_id
GROUP BY l.batch_id, l.pair_id
""",
    "inbatch_similarity": f"""
WITH {IN_BATCH}
SELECT batch_id, pair_id, side, {r6('lse')} AS lse, {r6('partner_sim')} AS partner_sim, {r6('ce')} AS ce FROM ce
""",
    "inbatch_loss": f"""
WITH {IN_BATCH}
SELECT batch_id, {r6('avg(ce)')} AS loss FROM ce GROUP BY batch_id
""",
    "cosent_loss": ranking_sql(f"20.0::DOUBLE * {ncos_sql('u', 'v')}"),
    "angle_loss": ranking_sql(angle_sql("u", "v")),
    "pair_loss": f"""
WITH {VEC_PAIRS}, {vec_negatives_sql()},
c AS (SELECT batch_id, score, {cos_sql('u', 'v')} AS cos12, {cos_sql('u', 'w')} AS cos13 FROM neg),
b AS (SELECT batch_id, avg(pow(cos12 - score, 2)) AS ls, avg(pow(cos13, 2)) AS ld FROM c GROUP BY batch_id)
SELECT batch_id, {r6('ls')} AS loss_similar, {r6('ld')} AS loss_dissimilar, {r6('ls + ld')} AS loss FROM b
""",
    "triplet_eval": f"""
WITH {VEC_PAIRS}, {vec_negatives_sql()},
t AS (SELECT batch_id, {dist_sql('u', 'v')} AS d_ap, {dist_sql('u', 'w')} AS d_an FROM neg)
SELECT batch_id, count(*) AS n, {r6('avg(greatest(0.0::DOUBLE, d_ap - d_an + 1.0::DOUBLE))')} AS loss,
       {r6('avg(CASE WHEN d_ap < d_an THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS accuracy
FROM t GROUP BY batch_id
""",
    "mean_pool": f"""
WITH tok AS (SELECT label AS sent_id, label // 5 AS batch_id, embedding::DOUBLE[] AS vec FROM embeddings),
ex AS (SELECT sent_id, batch_id, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM tok),
s AS (SELECT sent_id, batch_id, dim, sum(x) AS sx, count(*) AS n FROM ex GROUP BY ALL),
pl AS (SELECT batch_id, max(n) AS pad_len FROM s GROUP BY batch_id),
pooled AS (SELECT s.sent_id, s.dim, s.sx / pl.pad_len AS value FROM s JOIN pl USING (batch_id)),
w AS (SELECT i.i AS i, j.j AS j, ((7 * i.i + 13 * j.j) % 11 - 5) / 10.0::DOUBLE AS w
      FROM range(64) i(i), range(16) j(j)),
ro AS (SELECT p.sent_id, w.j AS dim, sum(w.w * p.value) AS value FROM pooled p JOIN w ON p.dim = w.i GROUP BY ALL),
rn AS (SELECT sent_id, dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY sent_id)), 1e-12) AS value FROM ro)
SELECT 'pooled' AS kind, sent_id AS label, dim::BIGINT AS dim, {r6('value')} AS value FROM pooled
UNION ALL SELECT 'readout', sent_id, dim::BIGINT, {r6('value')} FROM rn
""",
})
ORACLES["combined_loss"] = f"""
WITH {IN_BATCH},
ib AS (SELECT batch_id, avg(ce) AS loss FROM ce GROUP BY batch_id),
{ranking_ctes(angle_sql('u', 'v'), 'an')}
SELECT ib.batch_id, {r6('20.0::DOUBLE * ib.loss + an.loss')} AS loss FROM ib JOIN an ON ib.batch_id = an.batch_id
"""


# -- run logs -------------------------------------------------------------------------

DEFAULT_MODEL = "dumitrescustefan/bert-base-romanian-cased-v1"
EPOCH_LOG = """el AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
                    event_id AS step, 'dev/' || event_type AS metric, value FROM events)"""
RUN_METRICS_LONG = """rml AS (SELECT user_id AS run_id, (CASE WHEN event_id % 2 = 0 THEN 'dev_' ELSE 'test_' END) || event_type AS metric,
                      avg(value) AS value FROM events GROUP BY ALL)"""
_TYPES = ["click", "error", "purchase", "signup", "view"]
_METRICS = [f"{p}_{t}" for p in ("dev", "test") for t in _TYPES]
RUN_METRICS_WIDE = "rm AS (SELECT user_id AS run_id, " + ", ".join(
    f"avg(value) FILTER (WHERE event_id % 2 = {0 if p == 'dev' else 1} AND event_type = '{t}') AS {p}_{t}"
    for p in ("dev", "test") for t in _TYPES) + " FROM events GROUP BY user_id)"
RUN_CONFIG = """rc AS (SELECT d.doc_id AS run_id, d.lang AS model_name, d.source AS training_method,
       (32 + 32 * l.quality)::BIGINT AS batch_size, (4 + 4 * l.toxic)::BIGINT AS accumulate_grad_batches,
       (l.quality = 1) AS translate, (l.toxic = 1) AS negative,
       CASE WHEN l.quality = 1 THEN ['ro-sts', 'biblical_01'] WHEN l.quality = 0 THEN ['biblical_01'] END AS tdn
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def list_text(x: str) -> str:
    return f"coalesce('[''' || array_to_string({x}, ''', ''') || ''']', 'None')"


def bool_text(x: str) -> str:
    return f"coalesce(CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END, 'None')"


NAME_PAT = "'^(dev|test)[/_](.*)$'"

ORACLES.update({
    "config_overlay": f"""
WITH {RUN_CONFIG}, {RUN_METRICS_WIDE},
hist AS (SELECT user_id AS run_id, count(*) AS n_epochs FROM events GROUP BY user_id)
SELECT rc.run_id, 1 AS gpus, coalesce(batch_size, 256) AS batch_size, coalesce(accumulate_grad_batches, 16) AS accumulate_grad_batches,
       2e-05::DOUBLE AS lr, 512 AS model_max_length, 20 AS max_train_epochs,
       coalesce(model_name, '{DEFAULT_MODEL}') AS model_name, coalesce(training_method, 'simple-train') AS training_method,
       coalesce(translate, false) AS data_augmentation_translate_data, negative AS data_augmentation_negative_samples,
       {list_text("coalesce(tdn, ['ro-sts'])")} AS train_dataset_name,
       'ro-sts' AS dev_dataset_name, 'ro-sts' AS test_dataset_name, hist.n_epochs, {r6('rm.dev_click')} AS dev_click
FROM rc LEFT JOIN hist ON rc.run_id = hist.run_id LEFT JOIN rm ON rc.run_id = rm.run_id
""",
    "log_tail_drop": f"""
WITH {EPOCH_LOG}, m AS (SELECT run_id, max(epoch) AS last FROM el GROUP BY run_id)
SELECT el.run_id, epoch, metric, {r6('value')} AS value FROM el JOIN m ON el.run_id = m.run_id
WHERE epoch <= last - 2 AND value IS NOT NULL AND NOT isnan(value)
""",
    "labels_and_names": f"""
WITH {RUN_METRICS_LONG}, {RUN_CONFIG},
x AS (SELECT r.run_id, r.metric, r.value, rc.model_name, rc.translate,
             nullif(regexp_extract(r.metric, {NAME_PAT}, 1), '') AS prefix,
             nullif(regexp_extract(r.metric, {NAME_PAT}, 2), '') AS suffix
      FROM rml r LEFT JOIN rc ON r.run_id = rc.run_id WHERE r.value IS NOT NULL)
SELECT run_id, metric, prefix, suffix, replace(concat_ws('/', prefix, suffix), '/', '_') AS safe_name,
       concat_ws('/', coalesce(model_name, 'None'), {bool_text('translate')}) AS label,
       concat_ws(', ', 'model_name=' || coalesce(model_name, 'None'), 'data_augmentation_translate_data=' || {bool_text('translate')}) AS title,
       {fixed4_sql('value')} AS value_text
FROM x
""",
    "best_run_per_metric": f"""
WITH {RUN_METRICS_LONG},
a AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, run_id) AS rmax,
                row_number() OVER (PARTITION BY metric ORDER BY value ASC, run_id) AS rmin FROM rml WHERE value IS NOT NULL)
SELECT metric, max(run_id) FILTER (WHERE rmax = 1) AS max_run, {r6('max(value) FILTER (WHERE rmax = 1)')} AS max_value,
       max(run_id) FILTER (WHERE rmin = 1) AS min_run, {r6('max(value) FILTER (WHERE rmin = 1)')} AS min_value
FROM a GROUP BY metric
""",
    "mean_over_repeats": f"""
WITH {RUN_METRICS_WIDE}
SELECT run_id // 10 AS config_id, count(*) AS n_repeats, {', '.join(f"{r6(f'avg({m})')} AS {m}" for m in _METRICS)}
FROM rm GROUP BY run_id // 10
""",
    "best_epoch": f"""
WITH {EPOCH_LOG},
a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC NULLS LAST, epoch) AS rb FROM el)
SELECT run_id, count(*) AS n_epochs, max(epoch) FILTER (WHERE rb = 1) AS best_epoch, {r6('max(value) FILTER (WHERE rb = 1)')} AS best_value
FROM a GROUP BY run_id
""",
    "early_stop": f"""
WITH {EPOCH_LOG},
a AS (SELECT *, max(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM el),
b AS (SELECT *, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND (prev IS NULL OR value > prev) THEN epoch END AS imp FROM a),
c AS (SELECT *, max(imp) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM b),
s AS (SELECT run_id, min(CASE WHEN epoch - coalesce(last_imp, -1) >= 4 AND epoch < 60 THEN epoch END) AS stop_epoch, max(epoch) AS last
      FROM c GROUP BY run_id)
SELECT run_id, stop_epoch, (stop_epoch IS NULL AND last + 1 >= 60) AS capped FROM s
""",
    "curves": f"""
WITH {EPOCH_LOG}, m AS (SELECT run_id, max(epoch) AS last FROM el GROUP BY run_id),
lg AS (SELECT el.* FROM el JOIN m ON el.run_id = m.run_id WHERE epoch <= last - 2 AND value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT *, nullif(regexp_extract(metric, {NAME_PAT}, 2), '') AS suffix FROM lg),
fr AS (SELECT suffix, min(epoch) AS seen FROM s WHERE run_id = (SELECT min(run_id) FROM s) GROUP BY suffix),
fo AS (SELECT suffix, row_number() OVER (ORDER BY seen, suffix) AS suffix_pos FROM fr),
rc AS (SELECT doc_id AS run_id, lang AS model_name FROM documents)
SELECT s.suffix, fo.suffix_pos, s.run_id, coalesce(rc.model_name, 'None') AS label,
       row_number() OVER (PARTITION BY s.run_id, s.metric ORDER BY s.epoch) - 1 AS epoch, {r6('s.value')} AS value
FROM s LEFT JOIN fo ON s.suffix = fo.suffix LEFT JOIN rc ON s.run_id = rc.run_id
""",
    "effective_batch": f"""
WITH {RUN_CONFIG}
SELECT run_id, 16 * coalesce(accumulate_grad_batches, 16)::BIGINT AS own_batch, (b.pos * 4 + a.pos)::BIGINT AS grid_pos,
       b.v AS batch_size, a.v AS accumulate_grad_batches, b.v::BIGINT * a.v::BIGINT AS effective_batch
FROM rc, (VALUES (0, 16), (1, 32), (2, 64), (3, 256)) b(pos, v), (VALUES (0, 1), (1, 4), (2, 8), (3, 16)) a(pos, v)
""",
    "pad_symbol": """
SELECT d.doc_id AS run_id,
       coalesce(CASE WHEN l.quality = 1 THEN '[PAD]' END, CASE WHEN l.toxic = 0 THEN '[SEP]' END,
                CASE WHEN l.quality IS NOT NULL THEN '</s>' END, NULL, '[CLS]') AS pad,
       CASE WHEN l.quality = 1 THEN 'pad' WHEN l.toxic = 0 THEN 'sep' WHEN l.quality IS NOT NULL THEN 'eos' ELSE 'cls' END AS pad_source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
})

_REPORT_RUNS = [12, 3, 7, 140, 0, 55, 99, 21, 8, 130, 64, 149]
ORACLES["report_sorted"] = f"""
WITH {RUN_METRICS_WIDE}, {RUN_CONFIG},
cfg AS (SELECT run_id, coalesce(model_name, '{DEFAULT_MODEL}') AS model_name, coalesce(tdn, ['ro-sts']) AS tdn,
               coalesce(translate, false) AS translate FROM rc),
sel AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(_REPORT_RUNS))}) t(sel_pos, run_id)),
rep AS (SELECT s.sel_pos, c.run_id, c.model_name, c.tdn, c.translate, {', '.join('rm.' + m for m in _METRICS)}
        FROM sel s JOIN cfg c ON s.run_id = c.run_id LEFT JOIN rm ON c.run_id = rm.run_id)
SELECT sel_pos::BIGINT AS sel_pos,
       row_number() OVER (ORDER BY model_name NULLS FIRST, tdn NULLS FIRST, translate NULLS FIRST, run_id) AS sort_pos,
       run_id, model_name, {list_text('tdn')} AS train_dataset_name, translate AS data_augmentation_translate_data,
       {', '.join(f"{r6(m)} AS {m}" for m in sorted(_METRICS))}
FROM rep
"""


# -- text, catalog, files ---------------------------------------------------------------

TOKEN_PAT = r"'[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'"
LANGS = "['en', 'fr', 'de', 'es', 'it']"

ORACLES.update({
    "tokenise_pad": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {TOKEN_PAT}) AS toks FROM documents),
ex AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM t),
voc AS (SELECT token, row_number() OVER (ORDER BY md5(token), token) AS token_id FROM (SELECT DISTINCT token FROM ex)),
ids AS (SELECT ex.doc_id, list(voc.token_id ORDER BY ex.pos) AS ids FROM ex JOIN voc ON ex.token = voc.token
        WHERE ex.pos < 512 GROUP BY ex.doc_id),
d AS (SELECT d.doc_id, coalesce(ids.ids, []::BIGINT[]) AS ids, (row_number() OVER (ORDER BY d.doc_id) - 1) // 16 AS batch_id
      FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id),
p AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS plen FROM d)
SELECT doc_id, batch_id, n::BIGINT AS n_tokens, plen::BIGINT AS padded_length,
       md5(array_to_string(list_concat(ids, list_transform(range(plen - n), lambda x: 0::BIGINT)), ',')) AS ids_hash,
       n::BIGINT AS mask_sum
FROM p
""",
    "encode_score": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {TOKEN_PAT}) AS toks FROM documents),
ex AS (SELECT doc_id, unnest(toks) AS token FROM t),
pt AS (SELECT doc_id, token, count(*) AS c FROM ex GROUP BY doc_id, token),
vec AS (SELECT doc_id, (('0x' || substr(md5(token), 1, 8))::UBIGINT % 256)::INTEGER AS dim, sum(c)::DOUBLE AS w FROM pt GROUP BY ALL),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM vec GROUP BY doc_id),
tp AS (SELECT a.doc_id AS pair_id, a.doc_id AS doc_a, b.doc_id AS doc_b, (a.n_chars % 6)::DOUBLE / 5.0::DOUBLE AS score
       FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
dots AS (SELECT tp.pair_id, sum(va.w * vb.w) AS dot FROM tp JOIN vec va ON va.doc_id = tp.doc_a
         JOIN vec vb ON vb.doc_id = tp.doc_b AND vb.dim = va.dim GROUP BY tp.pair_id),
c AS (SELECT tp.pair_id, tp.score,
             coalesce(dots.dot, 0) / (greatest(coalesce(na.n, 0), 1e-6) * greatest(coalesce(nb.n, 0), 1e-6)) AS cos
      FROM tp LEFT JOIN dots ON dots.pair_id = tp.pair_id LEFT JOIN nrm na ON na.doc_id = tp.doc_a LEFT JOIN nrm nb ON nb.doc_id = tp.doc_b)
SELECT pair_id, {r6('score')} AS sim, {r6('cos')} AS prediction, {r6('pow(cos - score, 2)')} AS sq_error FROM c
""",
    "augment_lookup": f"""
WITH {TURN_PAIRS}, {negatives_sql('turn_pairs')},
tr AS (SELECT pair_id, text1 AS sentence1, text2 AS sentence2, sentence3 FROM neg),
b AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id FROM tr),
r0 AS (SELECT *, {unit_sql("'42'", "'route'", '0', 'batch_id')} AS u, {unit_sql("'42'", "'lang'", '0', 'batch_id')} AS ul FROM b),
r AS (SELECT *, CASE WHEN u < 0.3 THEN 1 WHEN u < 0.7 THEN 2 ELSE 3 END AS route,
             {LANGS}[floor(ul * 5)::INTEGER + 1] AS lang FROM r0),
src AS (SELECT conv_id, turn, text AS src_text FROM conversations WHERE role = 'user'),
nx AS (SELECT conv_id, turn - 1 AS turn, text AS replacement FROM conversations),
tm AS (SELECT md5(src_text) AS text_key, {LANGS}[floor({unit_sql("'tm'", 'src.conv_id')} * 5)::INTEGER + 1] AS lang,
              min(replacement) AS replacement
       FROM src JOIN nx ON src.conv_id = nx.conv_id AND src.turn = nx.turn GROUP BY ALL)
SELECT r.pair_id, r.batch_id, r.route, r.lang, tm.replacement IS NOT NULL AS translated,
       CASE WHEN route = 1 THEN coalesce(tm.replacement, sentence1) ELSE sentence1 END AS sentence1,
       CASE WHEN route = 2 THEN coalesce(tm.replacement, sentence2) ELSE sentence2 END AS sentence2,
       CASE WHEN route = 3 THEN coalesce(tm.replacement, sentence3) ELSE sentence3 END AS sentence3
FROM r LEFT JOIN tm ON tm.text_key = md5(CASE route WHEN 1 THEN sentence1 WHEN 2 THEN sentence2 ELSE sentence3 END)
                    AND tm.lang = r.lang
""",
    "catalog_union": f"""
WITH {text_pairs_sql('ro', 6)}, {TURN_PAIRS},
ro2 AS (SELECT pair_id, score / 5.0::DOUBLE AS score, text1, text2,
               CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split
        FROM (SELECT *, {unit_sql("'split'", 'pair_id')} AS u FROM ro)),
pa AS (SELECT pair_id, text1, text2, CASE WHEN {unit_sql("'split'", 'pair_id')} < 0.8 THEN 'train' ELSE 'dev' END AS split
       FROM turn_pairs)
SELECT 'train' AS part, 'ro-sts' AS dataset, pair_id, {r6('score')} AS score, text1, text2 FROM ro2 WHERE split = 'train'
UNION ALL BY NAME
SELECT 'train' AS part, 'paraphrase-ro' AS dataset, pair_id, text1, text2 FROM pa WHERE split = 'train'
UNION ALL BY NAME
SELECT 'dev' AS part, 'ro-sts' AS dataset, pair_id, {r6('score')} AS score, text1, text2 FROM ro2 WHERE split = 'dev'
UNION ALL BY NAME
SELECT 'test' AS part, 'ro-sts' AS dataset, pair_id, {r6('score')} AS score, text1, text2 FROM ro2 WHERE split = 'test'
""",
    "tsv_roundtrip": f"""
WITH {text_pairs_sql('ro', 6)}, {TURN_PAIRS}, {text_pairs_sql('bib', 101)}
SELECT 'ro-sts' AS dataset, score, text1, text2 FROM ro
UNION ALL SELECT 'paraphrase-ro', NULL::DOUBLE, text1, text2 FROM turn_pairs
UNION ALL SELECT 'biblical_01', score, text1, text2 FROM bib
""",
})


# -- streaming: equal to the batch queries ----------------------------------------------

ORACLES["stream_metrics"] = f"""
SELECT l_returnflag AS stage, count(*) AS n, {r6(pearson_sql('l_quantity', 'l_extendedprice'))} AS pearson,
       {r6('avg(pow(l_extendedprice / 105000.0::DOUBLE - l_quantity / 50.0::DOUBLE, 2))')} AS avg_loss
FROM lineitem GROUP BY l_returnflag
"""
ORACLES["stream_stop"] = "SELECT run_id, stop_epoch FROM (" + ORACLES["early_stop"].replace(
    "AND epoch < 60 ", "") + ") WHERE stop_epoch IS NOT NULL"

ORACLES["stream_spearman"] = ORACLES["spearman_by_stage"]
ORACLES["stream_spearman_steps"] = f"""
WITH s AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem),
p AS (SELECT ((l_orderkey - lo) * 6) // (hi - lo + 1) AS step, l_returnflag AS stage, l_quantity::DOUBLE AS y,
             floor(l_extendedprice::DOUBLE / 100.0::DOUBLE) AS y_hat FROM lineitem, s),
b AS (SELECT DISTINCT step FROM p),
x AS (SELECT b.step AS batch, stage, y, y_hat FROM b JOIN p ON p.step <= b.step),
r AS (SELECT batch, stage,
        2 * rank() OVER (PARTITION BY batch, stage ORDER BY y) + count(*) OVER (PARTITION BY batch, stage, y) - 1 AS ry,
        2 * rank() OVER (PARTITION BY batch, stage ORDER BY y_hat) + count(*) OVER (PARTITION BY batch, stage, y_hat) - 1 AS rp FROM x)
SELECT batch::INTEGER AS batch, stage, count(*) AS n, {r6(pearson_sql('ry', 'rp'))} AS spearman FROM r GROUP BY batch, stage
"""
ORACLES["stream_epochs"] = f"""
WITH p AS (SELECT (l_linenumber % 3)::BIGINT AS run_id, nullif(l_returnflag, 'N') AS stage, l_orderkey // 4096 AS epoch, l_orderkey // 64 AS batch_id,
                  l_quantity::DOUBLE AS y, l_extendedprice::DOUBLE AS y_hat,
                  pow(l_extendedprice / 105000.0::DOUBLE - l_quantity / 50.0::DOUBLE, 2) AS loss FROM lineitem),
b AS (SELECT run_id, stage, epoch, batch_id, avg(loss) AS loss FROM p GROUP BY ALL),
l AS (SELECT run_id, stage, epoch, count(*) AS n_batches, avg(loss) AS avg_loss FROM b GROUP BY ALL),
m AS (SELECT run_id, stage, epoch, count(*) AS n, {pearson_sql('y', 'y_hat')} AS pearson FROM p GROUP BY ALL)
SELECT m.run_id, m.stage, m.epoch, n, n_batches, {r6('pearson')} AS pearson, {r6('avg_loss')} AS avg_loss, true AS complete
FROM m JOIN l ON m.run_id = l.run_id AND m.epoch = l.epoch AND m.stage IS NOT DISTINCT FROM l.stage
"""


# -- fits: closed forms ---------------------------------------------------------------

FEATURES = ["f_cos", "f_dist", "f_angle"]


def features_sql(src: str, u: str = "u", v: str = "v") -> str:
    nu, nv = nrm(u), nrm(v)
    return (f"SELECT *, {cos_sql(u, v)} AS f_cos, {dist_sql(u, v)} AS f_dist, coalesce({angle_sql(u, v, 1.0)}, 0) AS f_angle, "
            f"coalesce(least({nu}, {nv}) / nullif(greatest({nu}, {nv}), 0), 0) AS f_ratio FROM {src}")


FIT_PARTS = f"""{VEC_PAIRS},
feat AS ({features_sql('vec_pairs')}),
fkey AS (SELECT pair_id, score, f_cos, f_dist, f_angle, round(score * 9)::INTEGER AS skey FROM feat),
{split_sql('p1', 'fkey', 'pair_id', 'skey', 0.3, 'fit-1', 'train', 'temp')},
ptemp AS (SELECT * EXCLUDE (part) FROM p1 WHERE part = 'temp'),
{split_sql('p2', 'ptemp', 'pair_id', 'skey', 0.5, 'fit-2', 'dev', 'test')},
parts AS (SELECT part, pair_id, score, f_cos, f_dist, f_angle FROM p1 WHERE part = 'train'
          UNION ALL SELECT part, pair_id, score, f_cos, f_dist, f_angle FROM p2)"""


def grid_ctes(regs: list[float]) -> str:
    rows = ", ".join(f"({i * len(regs) + j}, '{f}', {r!r}::DOUBLE)" for i, f in enumerate(FEATURES) for j, r in enumerate(regs))
    pick = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES) + " END"
    return f"""cfg(config_pos, feature, reg_param) AS (VALUES {rows}),
long AS (SELECT config_pos, feature, reg_param, part, score, {pick} AS x FROM parts, cfg),
ln AS (SELECT config_pos, covar_pop(x, score) / (var_pop(x) + any_value(reg_param)) AS slope, avg(x) AS mx, avg(score) AS my
       FROM long WHERE part = 'train' GROUP BY config_pos),
pred AS (SELECT l.config_pos, feature, reg_param, part, score, slope * x + (my - slope * mx) AS p
         FROM long l JOIN ln ON l.config_pos = ln.config_pos WHERE part IN ('dev', 'test')),
rk AS (SELECT *, {rank2_sql('score', 'config_pos, part')}::DOUBLE AS ry, {rank2_sql('p', 'config_pos, part')}::DOUBLE AS rp FROM pred),
sc AS (SELECT config_pos, feature, reg_param, part, count(*) AS n, {pearson_sql('score', 'p')} AS pearson,
              {pearson_sql('ry', 'rp')} AS spearman, avg(pow(p - score, 2)) AS mse FROM rk GROUP BY ALL)"""


_sides = lambda c: ", ".join(f"max({c}) FILTER (WHERE part = '{p}') AS {p}_{c}" for p in ("dev", "test"))
ORACLES["grid_fit"] = f"""
WITH {FIT_PARTS}, {grid_ctes([0.0, 0.01, 0.1])},
w AS (SELECT config_pos, feature, reg_param, {_sides('n')}, {_sides('pearson')}, {_sides('mse')} FROM sc GROUP BY ALL)
SELECT config_pos, feature, reg_param, dev_n, test_n, {', '.join(f"{r6(f'{p}_{c}')} AS {p}_{c}" for p in ('dev', 'test') for c in ('pearson', 'mse'))}
FROM w
"""
ORACLES["regressor_eval"] = f"""
WITH {FIT_PARTS}, {grid_ctes([0.0])},
best AS (SELECT config_pos FROM sc WHERE part = 'dev' ORDER BY pearson DESC NULLS LAST, config_pos LIMIT 1)
SELECT part, feature, n, {r6('pearson')} AS pearson, {r6('spearman')} AS spearman, {r6('mse')} AS mse
FROM sc WHERE config_pos = (SELECT config_pos FROM best)
"""
ORACLES["staged_fit"] = f"""
WITH {FIT_PARTS},
noisy0 AS (SELECT a.emb AS u, b.emb AS v, 1.0::DOUBLE - abs(a.label - b.label) / 9.0::DOUBLE AS score
           FROM e a JOIN e b ON b.vec_id = a.vec_id + 2),
noisy AS ({features_sql('noisy0')}),
l1 AS (SELECT covar_pop(f_cos, score) / var_pop(f_cos) AS s, avg(score) - covar_pop(f_cos, score) / var_pop(f_cos) * avg(f_cos) AS i FROM noisy),
d AS (SELECT parts.*, l1.s * f_cos + l1.i AS base FROM parts, l1),
l2 AS (SELECT covar_pop(f_dist, score - base) / var_pop(f_dist) AS s,
              avg(score - base) - covar_pop(f_dist, score - base) / var_pop(f_dist) * avg(f_dist) AS i FROM d WHERE part = 'train'),
pr AS (SELECT part, score, base + l2.s * f_dist + l2.i AS p FROM d, l2 WHERE part IN ('dev', 'test')),
r AS (SELECT *, {rank2_sql('score', 'part')}::DOUBLE AS ry, {rank2_sql('p', 'part')}::DOUBLE AS rp FROM pr)
SELECT part, count(*) AS n, {r6(pearson_sql('score', 'p'))} AS pearson, {r6(pearson_sql('ry', 'rp'))} AS spearman,
       {r6('avg(pow(p - score, 2))')} AS mse FROM r GROUP BY part
"""


# -- ridge over several features: the normal equations, solved by elimination ---------------

TEXT_FEATURES = f"""tk AS (SELECT pair_id, regexp_extract_all(coalesce(text1, ''), {TOKEN_PAT}) AS t1, regexp_extract_all(coalesce(text2, ''), {TOKEN_PAT}) AS t2
  FROM tp),
tf AS (SELECT pair_id,
  coalesce(len(list_intersect(list_distinct(t1), list_distinct(t2)))::DOUBLE / nullif(len(list_distinct(list_concat(t1, t2))), 0), 1.0::DOUBLE) AS f_overlap,
  coalesce(least(len(t1), len(t2))::DOUBLE / nullif(greatest(len(t1), len(t2)), 0), 1.0::DOUBLE) AS f_length FROM tk)"""
ORACLES["pair_text_features"] = f"""
WITH {text_pairs_sql('tp', 6)}, {TEXT_FEATURES}
SELECT pair_id, {r6('f_overlap')} AS f_overlap, {r6('f_length')} AS f_length FROM tf
"""


def ridge_sql(name: str, src: str, features: list[str], regs: list[float], prior: str | None = None) -> str:
    """CTEs ending in ``name``: one row per ridge weight with w0.., b0 (intercept)."""
    k = len(features)
    gram = ", ".join(f"covar_pop({features[i]}, {features[j]}) AS g_{i}_{j}" for i in range(k) for j in range(k))
    cross = ", ".join(f"covar_pop({f}, score) AS c_{i}" for i, f in enumerate(features))
    means = ", ".join(f"avg({f}) AS m_{i}" for i, f in enumerate(features))
    start = [f"{prior}.w{i}" if prior else "0" for i in range(k)]
    cells = ", ".join(f"g_{i}_{j} + {'reg' if i == j else '0'} AS a_{i}_{j}" for i in range(k) for j in range(k))
    right = ", ".join(f"c_{i} + reg * {start[i]} AS a_{i}_{k}" for i in range(k))
    keep = "reg, my, " + ", ".join(f"m_{i}" for i in range(k))
    out = [f"{name}_m AS (SELECT avg(score) AS my, {gram}, {cross}, {means} FROM {src})",
           f"{name}_r(reg) AS (VALUES {', '.join(f'({r!r}::DOUBLE)' for r in regs)})",
           f"{name}_0 AS (SELECT {keep}, {cells}, {right} FROM {name}_m, {name}_r{', ' + prior if prior else ''})".replace("reg, my", f"{name}_r.reg, my", 1)
           .replace(" reg AS", f" {name}_r.reg AS").replace("+ reg *", f"+ {name}_r.reg *")]
    for p in range(k):
        rows = ", ".join(f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" if i != p else f"a_{p}_{j} / a_{p}_{p} AS a_{p}_{j}"
                         for i in range(k) for j in range(p + 1, k + 1))
        out.append(f"{name}_{p + 1} AS (SELECT {keep}, {rows} FROM {name}_{p})")
    weights = ", ".join(f"a_{i}_{k} AS w{i}" for i in range(k))
    out.append(f"{name} AS (SELECT reg, {weights}, my - ({' + '.join(f'a_{i}_{k} * m_{i}' for i in range(k))}) AS b0 FROM {name}_{k})")
    return ",\n".join(out)


def ridge_scores_sql(name: str, src: str, features: list[str]) -> str:
    return f"""pr AS (SELECT reg, part, score, b0 + {' + '.join(f'w{i} * {f}' for i, f in enumerate(features))} AS p FROM {src}, {name} WHERE part IN ('dev', 'test')),
rk AS (SELECT *, {rank2_sql('score', 'reg, part')}::DOUBLE AS ry, {rank2_sql('p', 'reg, part')}::DOUBLE AS rp FROM pr),
sc AS (SELECT part, reg AS reg_param, count(*) AS n, {pearson_sql('score', 'p')} AS pearson, {pearson_sql('ry', 'rp')} AS spearman, avg(pow(p - score, 2)) AS mse
       FROM rk GROUP BY ALL)
SELECT part, reg_param, n, {r6('pearson')} AS pearson, {r6('spearman')} AS spearman, {r6('mse')} AS mse,
       reg_param = (SELECT reg_param FROM sc WHERE part = 'dev' ORDER BY pearson DESC NULLS LAST, reg_param LIMIT 1) AS chosen FROM sc"""


RIDGES = [0.01, 0.1, 1.0]
FIVE = [*FEATURES, "f_overlap", "f_length"]
ORACLES["regressor_features"] = f"""
WITH {FIT_PARTS}, {text_pairs_sql('tp', 6)}, {TEXT_FEATURES},
five AS (SELECT parts.*, f_overlap, f_length FROM parts JOIN tf ON tf.pair_id = parts.pair_id),
tr AS (SELECT * FROM five WHERE part = 'train'),
{ridge_sql('mo', 'tr', FIVE, RIDGES)},
{ridge_scores_sql('mo', 'five', FIVE)}
"""
ORACLES["staged_features"] = f"""
WITH {FIT_PARTS},
noisy0 AS (SELECT a.emb AS u, b.emb AS v, 1.0::DOUBLE - abs(a.label - b.label) / 9.0::DOUBLE AS score
           FROM e a JOIN e b ON b.vec_id = a.vec_id + 2),
noisy AS ({features_sql('noisy0')}),
tr AS (SELECT * FROM parts WHERE part = 'train'),
{ridge_sql('one', 'noisy', FEATURES, RIDGES[:1])},
{ridge_sql('mo', 'tr', FEATURES, RIDGES, 'one')},
{ridge_scores_sql('mo', 'parts', FEATURES)}
"""


# -- run-log files -------------------------------------------------------------------

FILE_LOG = EPOCH_LOG + """,
fl AS (SELECT run_id, epoch, CASE WHEN run_id % 2 = 0 THEN metric ELSE 'val/' || split_part(metric, '/', 2) || '_epoch' END AS metric, value FROM el),
ml AS (SELECT run_id, max(epoch) AS last FROM fl GROUP BY run_id),
odd AS (SELECT min(user_id) AS broken, max(user_id) AS missing FROM events),
runs AS (SELECT DISTINCT user_id::INTEGER AS run_id FROM events)"""
ORACLES["runlog_metrics"] = f"""
WITH {FILE_LOG},
h AS (SELECT fl.run_id, epoch * 5 AS epoch, row_number() OVER (PARTITION BY fl.run_id, metric ORDER BY epoch) - 1 AS pos, metric, value
      FROM fl JOIN ml ON fl.run_id = ml.run_id JOIN odd ON fl.run_id NOT IN (broken, missing) WHERE epoch <= last - 2 AND value IS NOT NULL)
SELECT r.run_id, h.epoch, h.pos, h.metric, {r6('h.value')} AS value FROM runs r LEFT JOIN h ON r.run_id = h.run_id
"""
ORACLES["runlog_lines"] = f"""
WITH {FILE_LOG}
SELECT run_id::INTEGER AS run_id, count(*) AS rows, count(*) - (run_id = broken)::BIGINT AS parsed_rows, (run_id = broken)::BIGINT AS bad_rows
FROM fl JOIN odd ON run_id <> missing GROUP BY run_id, broken
"""
ORACLES["metric_log_replay"] = f"""
WITH {EPOCH_LOG}
SELECT run_id, epoch, metric, {r6('value')} AS value FROM el
"""
ORACLES["runlog_results"] = f"""
WITH {RUN_METRICS_LONG}
SELECT run_id::INTEGER AS run_id, metric, {r6('value')} AS value FROM rml WHERE value IS NOT NULL
UNION ALL SELECT DISTINCT user_id::INTEGER, 'extra_metric', 1.5::DOUBLE FROM events
"""
FILE_CONFIG = RUN_CONFIG + """,
fc AS (SELECT rc.* FROM rc)"""
ORACLES["runlog_hparams"] = f"""
WITH {FILE_CONFIG}
SELECT run_id::INTEGER AS run_id, batch_size, model_name, 1 AS gpus, 0.25::DOUBLE AS warmup_share, 20 AS max_train_epochs,
       translate AS data_augmentation_translate_data, '2e-05' AS lr, {list_text('tdn')} AS train_dataset_name, '[''ro-sts'']' AS test_dataset_name,
       13::BIGINT AS n_options
FROM fc
"""
ORACLES["runlog_report"] = f"""
WITH {FILE_CONFIG}, {RUN_METRICS_WIDE}
SELECT fc.run_id::INTEGER AS run_id, model_name, batch_size, {', '.join(f"{r6('rm.' + m)} AS {m}" for m in sorted(_METRICS))}, CASE WHEN rm.run_id IS NOT NULL THEN 1.5::DOUBLE END AS extra_metric
FROM fc LEFT JOIN rm ON fc.run_id = rm.run_id
"""


# -- loss options, triplets from text, epoch reports ------------------------------------

ORACLES["inbatch_weighted"] = f"""
WITH {VEC_PAIRS},
z AS (SELECT pair_id // 1000000 AS b, pair_id, 1 AS side, list_transform(u, lambda e: e / greatest({nrm('u')}, 1e-12)) AS xn, score FROM vec_pairs
      UNION ALL SELECT pair_id // 1000000, pair_id, 2, list_transform(v, lambda e: e / greatest({nrm('v')}, 1e-12)), score FROM vec_pairs),
pr AS (SELECT a.pair_id, a.side, a.score, a.pair_id = b.pair_id AS is_partner, list_dot_product(a.xn, b.xn) AS sim,
              20.0::DOUBLE * list_dot_product(a.xn, b.xn) + CASE WHEN a.pair_id = b.pair_id AND a.score = 0 THEN 5 ELSE 0 END AS logit
       FROM z a JOIN z b ON a.b = b.b AND NOT (a.pair_id = b.pair_id AND a.side = b.side)),
r AS (SELECT pair_id, side, any_value(score) AS score, max(logit) + ln(sum(exp(logit - 25))) + (25 - max(logit)) AS lse,
             max(sim) FILTER (WHERE is_partner) AS partner_sim, max(logit) FILTER (WHERE is_partner) AS pl FROM pr GROUP BY ALL)
SELECT pair_id, side, {r6('lse')} AS lse, {r6('partner_sim')} AS partner_sim, {r6('CASE WHEN score >= 0.9 THEN lse - pl ELSE 0.0 END')} AS ce FROM r
"""
ORACLES["epoch_report"] = f"""
WITH p AS (SELECT l_orderkey % 3 AS run_id, nullif(l_returnflag, 'N') AS stage, l_linenumber::BIGINT AS epoch, l_orderkey // 64 AS batch_id,
                  l_quantity AS y, l_extendedprice AS y_hat, pow(l_extendedprice / 105000.0::DOUBLE - l_quantity / 50.0::DOUBLE, 2) AS loss FROM lineitem),
r AS (SELECT *, {rank2_sql('y', 'run_id, stage, epoch')}::DOUBLE AS ry, {rank2_sql('y_hat', 'run_id, stage, epoch')}::DOUBLE AS rp FROM p),
c AS (SELECT run_id, stage, epoch, count(*) AS n, {r6(pearson_sql('y', 'y_hat'))} AS pearson, {r6(pearson_sql('ry', 'rp'))} AS spearman FROM r GROUP BY ALL),
b AS (SELECT run_id, stage, epoch, batch_id, avg(loss) AS bl FROM p GROUP BY ALL),
l AS (SELECT run_id, stage, epoch, count(*) AS n_batches, {r6('avg(bl)')} AS avg_loss FROM b GROUP BY ALL)
SELECT c.*, l.n_batches, l.avg_loss FROM c JOIN l ON c.run_id = l.run_id AND c.stage IS NOT DISTINCT FROM l.stage AND c.epoch = l.epoch
"""
_dist = lambda p: (f"pow(list_sum(list_transform(generate_series(1, len(u)), lambda i: pow(abs(u[i] - v[i] + 1e-6::DOUBLE), {p}))), 1.0::DOUBLE / {p})")
ORACLES["angle_mean_loss"] = f"""
WITH {VEC_PAIRS},
s AS (SELECT batch_id, score, {angle_sql('u', 'v', 300.0)} / len(u) AS s, {_dist(1)} AS d1, {_dist(3)} AS d3 FROM vec_pairs),
t AS (SELECT a.batch_id, sum(exp(a.s - z.s)) AS e FROM s a JOIN s z ON a.batch_id = z.batch_id AND a.score < z.score GROUP BY a.batch_id),
d AS (SELECT batch_id, avg(d1) AS d1, avg(d3) AS d3 FROM s GROUP BY batch_id)
SELECT d.batch_id, {r6('ln(1 + coalesce(t.e, 0))')} AS loss, {r6('d1')} AS d1, {r6('d3')} AS d3 FROM d LEFT JOIN t ON d.batch_id = t.batch_id
"""
ORACLES["triplet_text"] = f"""
WITH {TURN_PAIRS}, {negatives_sql('turn_pairs')},
tr AS (SELECT (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id, 'a' || pair_id AS a, 'b' || pair_id AS p,
              CASE WHEN side = 1 THEN 'a' ELSE 'b' END || donor_id AS n FROM neg),
docs AS (SELECT 'a' || pair_id AS id, text1 AS text FROM turn_pairs UNION ALL SELECT 'b' || pair_id, text2 FROM turn_pairs),
ex AS (SELECT id, unnest(regexp_extract_all(coalesce(text, ''), {TOKEN_PAT})) AS token FROM docs),
vec AS (SELECT id, (('0x' || substr(md5(token), 1, 8))::UBIGINT % 256)::INTEGER AS dim, count(*)::DOUBLE AS w FROM ex GROUP BY ALL),
dense AS (SELECT d.id, x.dim, coalesce(v.w, 0) AS w FROM docs d CROSS JOIN (SELECT unnest(range(256))::INTEGER AS dim) x
          LEFT JOIN vec v ON v.id = d.id AND v.dim = x.dim),
ds AS (SELECT tr.batch_id, tr.a, sqrt(sum(pow(va.w - vp.w + 1e-6::DOUBLE, 2))) AS d_ap, sqrt(sum(pow(va.w - vn.w + 1e-6::DOUBLE, 2))) AS d_an
       FROM tr JOIN dense va ON va.id = tr.a JOIN dense vp ON vp.id = tr.p AND vp.dim = va.dim JOIN dense vn ON vn.id = tr.n AND vn.dim = va.dim
       GROUP BY tr.batch_id, tr.a),
b AS (SELECT batch_id, count(*) AS n, avg(greatest(0.0::DOUBLE, d_ap - d_an + 1.0::DOUBLE)) AS loss,
             avg(CASE WHEN d_ap < d_an THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy FROM ds GROUP BY batch_id)
SELECT batch_id, n, {r6('loss')} AS loss, {r6('accuracy')} AS accuracy FROM b
UNION ALL SELECT NULL, count(*), {r6('avg(loss)')}, {r6('avg(accuracy)')} FROM b
"""


# -- queries of operators that had unit tests only --------------------------------------

ORACLES["categorical_loss"] = f"""
WITH x AS (SELECT l_orderkey, l_extendedprice::DOUBLE / 10000.0::DOUBLE AS z, l_quantity::DOUBLE / 50.0::DOUBLE AS t FROM lineitem),
m AS (SELECT l_orderkey, max(z) AS m FROM x GROUP BY l_orderkey),
s AS (SELECT x.l_orderkey, any_value(m) + ln(sum(exp(z - m))) AS lse FROM x JOIN m ON x.l_orderkey = m.l_orderkey GROUP BY x.l_orderkey)
SELECT x.l_orderkey, {r6('-sum(t * (z - lse))')} AS ce FROM x JOIN s ON x.l_orderkey = s.l_orderkey GROUP BY x.l_orderkey
"""
ORACLES["loss_by_name"] = f"""
WITH {VEC_PAIRS}
SELECT 'MSE' AS name, batch_id, {r6(f"avg(pow({cos_sql('u', 'v')} - score, 2))")} AS loss FROM vec_pairs GROUP BY batch_id
UNION ALL SELECT 'AnglE', batch_id, loss FROM ({ORACLES['combined_loss']})
"""
ORACLES["results_roundtrip"] = f"""
WITH {RUN_METRICS_WIDE}
SELECT run_id, {', '.join(f"{r6(m)} AS {m}" for m in _METRICS)} FROM rm
"""
ORACLES["catalog_train_dev"] = f"""
WITH {text_pairs_sql('ro', 6)}, {TURN_PAIRS}
SELECT 'train' AS part, 'ro-sts' AS dataset, pair_id, {r6('score / 5.0::DOUBLE')} AS score, text1, text2 FROM ro WHERE {unit_sql("'split'", 'pair_id')} < 0.7
UNION ALL SELECT 'dev', 'paraphrase-ro', pair_id, NULL::DOUBLE, text1, text2 FROM turn_pairs WHERE {unit_sql("'split'", 'pair_id')} >= 0.8
"""
ORACLES["encode_custom"] = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {TOKEN_PAT}) AS k, length(coalesce(text, '')) AS c FROM documents),
v AS (SELECT doc_id, [len(k)::DOUBLE, len(list_distinct(k))::DOUBLE, c::DOUBLE] AS v FROM t)
SELECT a.doc_id AS pair_id, {r6(cos_sql('a.v', 'b.v'))} AS cos FROM v a JOIN v b ON b.doc_id = a.doc_id + 1
"""

# The filter and the buckets change what moves, not what comes out.
ORACLES["key_filtered"] = ORACLES["key_semi_anti"]
ORACLES["augment_filtered"] = ORACLES["augment_lookup"]
ORACLES["encode_stored"] = ORACLES["encode_score"]
ORACLES["parts_bucketed"] = f"""
WITH {text_pairs_sql('ro', 6)},
p AS (SELECT *, {unit_sql("'split'", 'pair_id')} AS u FROM ro)
SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS part, count(*) AS n,
       sum(length(text1) + length(text2))::BIGINT AS n_chars, {r6('avg(score / 5.0::DOUBLE)')} AS mean_score
FROM p GROUP BY 1
"""
