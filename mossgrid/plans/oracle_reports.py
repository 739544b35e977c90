"""SQL counterparts of the report scores, of all metrics together and of the comparison."""

from __future__ import annotations

from mossgrid.functions import lexicon
from mossgrid.plans import oracle_parts as O

N = r"""'(\d+\.?\d*)'"""


def structs(rows: list[dict]) -> str:
    show = lambda v: O.lit(v) if isinstance(v, str) else f"{float(v)}::DOUBLE"
    return "[" + ", ".join("{" + ", ".join(f"'{k}': {show(v)}" for k, v in r.items()) + "}" for r in rows) + "]"


TERMS = structs([{"kind": k, "term": t, "severity": s, "weight": w} for k, ts, s, w in lexicon.FINDINGS for t in ts])
MODIFIERS = structs([{"word": w, "factor": f} for w, f in lexicon.SEVERITIES])
MARKERS = structs([{"word": w, "factor": f} for w, f in lexicon.CONFIDENCES])
SIZE = "coalesce(" + ", ".join(f"nullif(regexp_extract(c, {O.lit(p)}), '')" for p in lexicon.SIZES) + ")"

# All mentions of findings: m(pred_id, model, side, o, kind, term, start, weight, severity, doubt, size, denied).
MENTIONS = rf"""{O.REPORTS},
side AS (SELECT pred_id, model, 'g' AS side, lower(g) AS x FROM rep UNION ALL SELECT pred_id, model, 'r', lower(r) FROM rep),
t AS (SELECT row_number() OVER () AS o, u.* FROM (SELECT unnest({TERMS}) AS u)),
hit AS (SELECT pred_id, model, side, x, o, t.kind, t.term, t.severity, t.weight, regexp_split_to_array(x, '\b' || t.term || '\b') AS parts FROM side JOIN t ON contains(x, t.term)),
place AS (SELECT *, unnest(range(1, len(parts))) AS i FROM hit WHERE len(parts) > 1),
spot AS (SELECT * EXCLUDE (parts, i), list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT + (i - 1) * length(term) AS start FROM place),
ctx AS (SELECT *, substr(x, greatest(0, start - 50) + 1, least(length(x), start + length(term) + 50) - greatest(0, start - 50)) AS c,
  substr(x, greatest(0, start - 50) + 1, start - greatest(0, start - 50)) AS b FROM spot),
m AS (SELECT pred_id, model, side, o, kind, term, start, weight, severity * coalesce(list_filter({MODIFIERS}, lambda w: contains(c, w.word))[1].factor, 1) AS severity,
  coalesce(1 - list_filter({MARKERS}, lambda w: contains(c, w.word))[1].factor, 0) AS doubt, {SIZE} AS size,
  regexp_matches(b, {O.lit(r'\b(' + '|'.join(lexicon.NEGATIONS) + r')\b')}) AS denied FROM ctx)"""


def similar(a: str, b: str) -> str:
    x, y = (f"regexp_extract({s}, {N}, 1)::DOUBLE" for s in (a, b))
    d = f"abs({x} - {y}) / greatest(abs({x}), abs({y}))"
    return f"CASE WHEN {x} = 0 AND {y} = 0 THEN 1.0 WHEN {d} < 0.1 THEN 1.0 WHEN {d} < 0.2 THEN 0.8 WHEN {d} < 0.5 THEN 0.5 ELSE 0.2 END"


MATCH = f"""CASE WHEN r.denied = g.denied THEN 0.4 ELSE 0 END + 0.3 * greatest(0.0, 1 - abs(r.severity - g.severity) / 4) + 0.2 * greatest(0.0, 1 - abs(r.doubt - g.doubt))
  + CASE WHEN r.size IS NOT NULL AND g.size IS NOT NULL THEN 0.1 * ({similar('r.size', 'g.size')}) WHEN r.size IS NULL AND g.size IS NULL THEN 0.1 ELSE 0 END"""
DENIAL = "CASE WHEN r.denied = g.denied THEN 0.6 ELSE 0 END + 0.4 * greatest(0.0, 1 - 2 * abs(r.doubt - g.doubt))"
SIZED = f"CASE WHEN g.size IS NULL THEN 0 ELSE {similar('r.size', 'g.size')} END"
LOCATIONS = {s: O.present(f"lower({s})", lexicon.LOCATIONS) for s in "gr"}
TIMES = {s: O.present(f"lower({s})", lexicon.TIMES) for s in "gr"}

# Components of every report: z(pred_id, model, the components, severity_correlation, counts).
SCORED = f"""{MENTIONS},
best AS (
  SELECT r.pred_id, r.o, r.start, any_value(r.weight) AS weight, any_value(r.severity) AS severity, any_value(r.size) AS size, count(g.o) > 0 AS shared,
    coalesce(bool_or(g.term = r.term), false) AS caught, coalesce(max({MATCH}) FILTER (g.o IS NOT NULL), 0) AS match,
    coalesce(max({DENIAL}) FILTER (g.o IS NOT NULL), 0) AS denial, coalesce(max({SIZED}) FILTER (g.o IS NOT NULL), 0) AS sized,
    arg_min(g.severity, g.start) FILTER (g.term = r.term) AS paired
  FROM (SELECT * FROM m WHERE side = 'r') r LEFT JOIN (SELECT * FROM m WHERE side = 'g') g ON g.pred_id = r.pred_id AND g.kind = r.kind
  GROUP BY r.pred_id, r.o, r.start),
per AS (
  SELECT pred_id, count(*) AS n_ref, sum(weight * match) / sum(weight) AS entity, avg(denial) FILTER (shared) AS denial, avg(sized) FILTER (shared AND size IS NOT NULL) AS sized,
    sum(weight * (1 + severity / 4)) FILTER (caught) / sum(weight * (1 + severity / 4)) AS captured,
    count(*) FILTER (caught) AS n_pairs, min(severity) FILTER (caught) = max(severity) FILTER (caught) OR min(paired) FILTER (caught) = max(paired) FILTER (caught) AS flat,
    corr(severity, paired) FILTER (caught) AS corr
  FROM best GROUP BY pred_id),
made AS (SELECT pred_id, count(*) AS n_gen FROM m WHERE side = 'g' GROUP BY pred_id),
kinds AS (SELECT pred_id, count(DISTINCT kind) FILTER (both_) AS n_both FROM (SELECT pred_id, kind, count(DISTINCT side) = 2 AS both_ FROM m GROUP BY ALL) GROUP BY ALL),
found AS (SELECT *, {LOCATIONS['g']} AS lg, {LOCATIONS['r']} AS lr, {TIMES['g']} AS tg, {TIMES['r']} AS tr, ({O.SECTIONS_G})::DOUBLE / nullif({O.SECTIONS_R}, 0) AS sections,
  CASE WHEN length(r) = 0 THEN 0.0 ELSE length(g)::DOUBLE / length(r) END AS q FROM rep),
z0 AS (
  SELECT pred_id, model, g, r, coalesce(n_ref, 0) AS ref_entities, coalesce(n_gen, 0) AS gen_entities, coalesce(n_both, 0) AS n_matched,
    CASE WHEN n_ref IS NULL THEN (n_gen IS NULL)::INT ELSE entity END::DOUBLE AS entity_matching,
    CASE WHEN len(lr) = 0 THEN (len(lg) = 0)::INT ELSE len(list_intersect(lr, lg))::DOUBLE / len(list_distinct(list_concat(lr, lg))) END::DOUBLE AS location_accuracy,
    coalesce(denial, 1)::DOUBLE AS negation_handling,
    CASE WHEN len(tr) = 0 THEN CASE WHEN len(tg) = 0 THEN 1 ELSE 0.5 END
      ELSE 0.5 * len(list_intersect(tr, tg)) / len(tr) + 0.5 * CASE WHEN len(tg) > 0 AND n_gen > 0 AND n_ref > 0 THEN 0.8 ELSE 0.5 END END::DOUBLE AS temporal_accuracy,
    coalesce(sized, 1)::DOUBLE AS measurement_accuracy, CASE WHEN n_ref IS NULL THEN 0 ELSE coalesce(captured, 0) END::DOUBLE AS clinical_significance,
    0.7 * coalesce(sections, 1) + 0.3 * CASE WHEN q < 2 THEN least(1.0, q) ELSE greatest(0.0, 2 - q) END AS structure_completeness,
    CASE WHEN coalesce(n_pairs, 0) = 0 THEN 0 WHEN flat THEN 0.5 ELSE (greatest(-1, least(1, corr)) + 1) / 2 END::DOUBLE AS severity_correlation
  FROM found LEFT JOIN per USING (pred_id) LEFT JOIN made USING (pred_id) LEFT JOIN kinds USING (pred_id)),
z AS (SELECT *, {' + '.join(f'{w} * {k}' for k, w in lexicon.WEIGHTS.items())} AS overall FROM z0)"""

COMPONENTS = [*lexicon.WEIGHTS, "overall", "severity_correlation"]


def component(*names: str) -> str:
    return f"WITH {SCORED} SELECT pred_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM z"


STATS = ", ".join(
    f"round({f}({c}), 6) AS {c}_{name}" for c in COMPONENTS for name, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
)

ORACLE: dict[str, str] = {
    "green_entities": f"""WITH {MENTIONS} SELECT kind, term, count(*) AS n, count(*) FILTER (denied) AS n_denied, count(size) AS n_sized, round(avg(severity), 6) AS severity, round(avg(doubt), 6) AS doubt
FROM m WHERE side = 'r' GROUP BY ALL""",
    "green_negation": component("negation_handling"),
    "green_measurement": component("measurement_accuracy"),
    "green_significance": component("clinical_significance"),
    "green_severity_corr": component("severity_correlation"),
    "green_overall": component("entity_matching", "overall"),
    "green_rollup": f"""WITH {SCORED} SELECT model, {STATS}, round(avg(ref_entities), 6) AS avg_ref_entities, round(avg(gen_entities), 6) AS avg_gen_entities,
  round(avg(n_matched), 6) AS avg_matched_kinds, count(*) AS valid_samples FROM z GROUP BY model""",
}

# BLEU of four orders: bl(model, bleu_score).
GRAMS = " UNION ALL ".join(
    f"SELECT pred_id, model, {n} AS n, '{s}' AS s, unnest(list_transform(range(1, len({s}) - {n - 2}), lambda i: array_to_string({s}[i:i + {n - 1}], ' '))) AS w FROM tok"
    for n in (1, 2, 3, 4)
    for s in "pr"
)
BLEU = f"""tok AS (SELECT pred_id, model, {O.TOKENS.replace('{x}', 'g')} AS p, {O.TOKENS.replace('{x}', 'r')} AS r FROM rep),
gram AS ({GRAMS}),
counted AS (SELECT pred_id, model, n, w, count(*) FILTER (s = 'p') AS cp, count(*) FILTER (s = 'r') AS cr FROM gram GROUP BY ALL),
prec AS (SELECT pred_id, model, n, {O.div('sum(least(cp, cr))', 'sum(cp)')} AS v FROM counted GROUP BY ALL),
tot AS (SELECT model, count(*) AS k, sum(len(p)) AS lp, sum(len(r)) AS lr FROM tok GROUP BY model),
ord AS (SELECT model, list(v ORDER BY n) AS vs FROM (SELECT model, n, sum(v) AS v FROM prec GROUP BY ALL) GROUP BY model),
bl AS (SELECT model, coalesce(CASE WHEN lp > lr THEN 1 WHEN lp = 0 THEN 0 ELSE exp(1 - lr::DOUBLE / lp) END
  * CASE WHEN len(vs) = 4 AND list_min(vs) > 0 THEN exp(list_avg(list_transform(vs, lambda v: ln(v / k)))) ELSE 0 END, 0) AS bleu_score FROM tot LEFT JOIN ord USING (model))"""
ORACLE["bleu"] = ORACLE["bleu_4"] = f"WITH {O.REPORTS}, {BLEU} SELECT model, round(bleu_score, 6) AS bleu_score FROM bl"


def long(table: str, task: str, *metrics: str) -> str:
    """Columns of a wide table as rows (model, task, metric, value)."""
    return " UNION ALL ".join(f"SELECT model, '{task}' AS task, '{m}' AS metric, ({m})::DOUBLE AS value FROM {table}" for m in metrics)


_EFFICACY = "CASE WHEN eg = er THEN 1.0 WHEN eg IN ('critical', 'abnormal') AND er IN ('critical', 'abnormal') THEN 0.5 ELSE 0.0 END"
_NUMBERS = " UNION ALL ".join(
    f"SELECT model, '{task}' AS task, ({p})::DOUBLE AS p, ({r})::DOUBLE AS r FROM c WHERE task = '{task}'"
    for task, p, r in (("counting", O.count_of("t"), f"floor({O.ref_number('ref')})"), ("regression", O.measure_of("t"), O.ref_number("ref")))
)
_BARE = lambda x: f"list_distinct(list_transform(list_filter({O.labels_of(x)}, lambda x: x <> ''), lambda x: {O.strip('x')}))"

# All metrics: metrics(model, task, metric, value).
METRICS = f"""{O.INST}, {SCORED.removeprefix(O.PAIRS + ', ')},
{BLEU},
cl AS (SELECT model, {O.label_norm('ref')} AS ref, {O.label_norm(O.choice_of('t'))} AS pred FROM c WHERE task = 'classification'),
ck AS (SELECT model, label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (
  SELECT model, ref AS label, 1 AS s, 0 AS p, (ref = pred)::INT AS h FROM cl UNION ALL SELECT model, pred, 0, 1, 0 FROM cl) GROUP BY ALL),
cm AS (SELECT model, avg(hits / support) FILTER (support > 0) AS balanced_accuracy, {O.div('sum(hits)', 'sum(support)')} AS accuracy,
  {O.div('sum(2.0 * hits / (support + predicted) * support)', 'sum(support)')} AS f1_score, sum(support) AS valid_samples FROM ck GROUP BY model),
ml AS (SELECT model, {_BARE('t')} AS p, {_BARE('r')} AS r FROM c WHERE task = 'multi-label'),
mp AS (SELECT model, {O.div('len(list_intersect(p, r))', 'len(p)')} AS p, {O.div('len(list_intersect(p, r))', 'len(r)')} AS r FROM ml WHERE len(r) > 0),
mm AS (SELECT model, avg({O.div('2 * p * r', 'p + r')}) AS f1_score, avg(p) AS precision, avg(r) AS recall, count(*) AS valid_samples FROM mp GROUP BY model),
db AS (SELECT model, {O.boxes_of('t')} AS p, {O.boxes_of('r')} AS r FROM c WHERE task = 'detection'),
ds AS (SELECT model, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nr - tp)::BIGINT AS fn, count(*) AS valid_samples
  FROM (SELECT model, {O.matched('p', 'r', '0.5')} AS tp, len(p) AS np, len(r) AS nr FROM db) GROUP BY model),
dm AS (SELECT model, {O.F1} AS f1_score, {O.PRECISION} AS precision, {O.RECALL} AS recall, valid_samples FROM ds),
{O.inst_sums('model, threshold::DOUBLE AS threshold', 'threshold')},
iq AS (SELECT model, threshold, {O.F1} AS f, {O.PRECISION} AS p, {O.RECALL} AS r FROM s),
im AS (SELECT model, any_value(k.n) AS valid_samples, coalesce(avg(f), 0) AS average_f1, coalesce(avg(p), 0) AS average_precision, coalesce(avg(r), 0) AS average_recall,
  {', '.join(f"coalesce(max({x}) FILTER (threshold = {t}), 0) AS {name}" for name, x, t in (('f1_score', 'f', 0.5), ('precision', 'p', 0.5), ('recall', 'r', 0.5), ('f1_score_at_03', 'f', 0.3), ('f1_score_at_05', 'f', 0.5), ('precision_at_03', 'p', 0.3), ('recall_at_03', 'r', 0.3)))}
  FROM (SELECT model, count(*) AS n FROM i GROUP BY model) k LEFT JOIN iq USING (model) GROUP BY model),
nu AS ({_NUMBERS}),
nm AS (SELECT model, task, coalesce(avg(abs(p - r)), 'inf'::DOUBLE) AS mean_absolute_error, sqrt(avg((p - r) * (p - r))) AS root_mean_squared_error, count(p - r) AS valid_samples FROM nu GROUP BY ALL),
ec AS (SELECT model, overall, {O.efficacy_of('lower(g)')} AS eg, {O.efficacy_of('lower(r)')} AS er FROM z),
em AS (SELECT model, avg(overall) AS green_score, avg({_EFFICACY}) AS clinical_efficacy, count(*) AS valid_samples FROM ec GROUP BY model),
rm AS (SELECT em.*, bleu_score FROM em JOIN bl USING (model)),
metrics AS (
  {long('cm', 'classification', 'balanced_accuracy', 'accuracy', 'f1_score', 'valid_samples')}
  UNION ALL {long('mm', 'multi-label', 'f1_score', 'precision', 'recall', 'valid_samples')}
  UNION ALL {long('dm', 'detection', 'f1_score', 'precision', 'recall', 'valid_samples')}
  UNION ALL {long('im', 'instance_detection', 'f1_score', 'precision', 'recall', 'f1_score_at_03', 'f1_score_at_05', 'precision_at_03', 'recall_at_03', 'average_f1', 'average_precision', 'average_recall', 'valid_samples')}
  UNION ALL SELECT model, task, metric, value FROM ({' UNION ALL '.join(f"SELECT model, task, '{m}' AS metric, {m}::DOUBLE AS value FROM nm" for m in ('mean_absolute_error', 'root_mean_squared_error', 'valid_samples'))}) WHERE value IS NOT NULL
  UNION ALL {long('rm', 'report_generation', 'green_score', 'bleu_score', 'clinical_efficacy', 'valid_samples')})"""
ORACLE["task_metrics"] = f"WITH {METRICS} SELECT model, task, metric, round(value, 6) AS value FROM metrics"


def compared(base: str, tuned: str) -> str:
    """Metrics of two models side by side: k(task, metric, base, finetuned, ...)."""
    primary = " OR ".join(
        f"task = '{t}' AND metric = '{m}'"
        for t, m in (
            ("classification", "balanced_accuracy"), ("multi-label", "f1_score"), ("detection", "f1_score"), ("instance_detection", "f1_score"),
            ("counting", "mean_absolute_error"), ("regression", "mean_absolute_error"), ("report_generation", "green_score"),
        )
    )
    return f"""{METRICS},
k0 AS (SELECT b.task, b.metric, b.value AS base, t.value AS finetuned, t.value - b.value AS absolute_diff FROM metrics b JOIN metrics t USING (task, metric) WHERE b.model = '{base}' AND t.model = '{tuned}'),
k AS (SELECT *, CASE WHEN base <> 0 THEN absolute_diff / base * 100 END AS relative_diff_percent,
  NOT isnan(absolute_diff) AND CASE WHEN metric IN ('mean_absolute_error', 'root_mean_squared_error') THEN absolute_diff < 0 ELSE absolute_diff > 0 END AS improvement,
  CASE WHEN base = 0 THEN abs(absolute_diff) * 100 WHEN isinf(base) THEN CASE WHEN isnan(absolute_diff) OR absolute_diff <> 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE abs(absolute_diff / base) * 100 END AS improvement_magnitude_percent,
  {primary} AS is_primary_metric FROM k0)"""


def comparison(base: str, tuned: str) -> dict[str, str]:
    numbers = ["base", "finetuned", "absolute_diff", "relative_diff_percent", "improvement_magnitude_percent"]
    rounded = ", ".join(f"round({n}, 6) AS {n}" for n in numbers)
    shown = lambda x: f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE printf('%.4f', {x}) END"
    return {
        "model_comparison": f"WITH {compared(base, tuned)} SELECT task, metric, {rounded}, improvement, is_primary_metric FROM k",
        "comparison_rollup": f"""WITH {compared(base, tuned)} SELECT count(*) FILTER (improvement) AS improved_tasks, count(*) AS total_tasks,
  coalesce(count(*) FILTER (improvement) * 100.0 / nullif(count(*), 0), 0)::DOUBLE AS improvement_rate FROM k WHERE is_primary_metric""",
        "comparison_report": f"""WITH {compared(base, tuned)} SELECT task, row_number() OVER (PARTITION BY task ORDER BY is_primary_metric DESC, metric)::INT AS place,
  CASE WHEN is_primary_metric THEN '* ' ELSE '  ' END || metric || ': ' || {shown('base')} || ' -> ' || {shown('finetuned')} || ' (' || CASE WHEN improvement THEN 'up ' ELSE 'down ' END
  || CASE WHEN isinf(improvement_magnitude_percent) THEN 'inf' ELSE printf('%.1f%%', improvement_magnitude_percent) END || ')' AS line FROM k
WHERE is_primary_metric OR metric IN ('accuracy', 'f1_score', 'balanced_accuracy', 'precision', 'recall', 'green_score', 'mean_absolute_error', 'root_mean_squared_error')""",
    }


ORACLE |= comparison("orbis-small", "lumen-7")
ORACLE["iou_all_pairs"] = f"""WITH {O.PAIRS}, b AS (SELECT pred_id, {O.boxes_of('t')} AS p, {O.boxes_of('r')} AS r FROM c WHERE task = 'detection'),
x AS (SELECT pred_id, r, unnest(p) AS a, generate_subscripts(p, 1) - 1 AS p_pos FROM b), y AS (SELECT pred_id, a, p_pos, unnest(r) AS b, generate_subscripts(r, 1) - 1 AS r_pos FROM x)
SELECT pred_id, p_pos, r_pos, round({O.iou('a', 'b')}, 6) AS iou FROM y"""
ORACLE["path_resolve_each"] = f"""WITH l AS (SELECT rec_id, dataset, {O.PATHS} AS ps FROM questions), q AS (SELECT rec_id, dataset, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS place FROM l),
f AS (SELECT dataset, lower(regexp_extract(path, '([^/]+)$', 1)) AS file, min(path) AS named FROM image_files GROUP BY ALL)
SELECT rec_id, place, coalesce(e.path, f.named) AS image FROM q LEFT JOIN (SELECT DISTINCT path FROM image_files) e ON e.path = q.dataset || '/' || q.p
LEFT JOIN f ON f.dataset = q.dataset AND f.file = {O.strip(r"lower(regexp_extract(q.p, '([^/\\]*)$', 1))")}"""

# Sections of a report: the header above a line decides; lines with a header are dropped.
_HEADS = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(lower(line), '{w}')" for w in words)} THEN '{name}'"
    for name, words in (
        ("findings", ["findings:", "finding:"]), ("impression", ["impression:", "impressions:", "conclusion:"]),
        ("recommendations", ["recommendation:", "recommendations:", "suggest:"]),
    )
) + " END"
_PART = lambda name: f"coalesce(string_agg({O.strip('line')}, ' ' ORDER BY i) FILTER (head IS NULL AND section = '{name}' AND {O.strip('line')} <> ''), '')"
ORACLE["submit_report_sections"] = f"""WITH {O.OUT}, r AS (SELECT pred_id, raw, string_split(raw, chr(10)) AS lines FROM c WHERE task = 'report_generation'),
l AS (SELECT pred_id, raw, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM r), h AS (SELECT *, {_HEADS} AS head FROM l),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY pred_id ORDER BY i), 'findings') AS section FROM h),
p AS (SELECT pred_id, any_value(raw) AS raw, {_PART('findings')} AS f, {_PART('impression')} AS im, {_PART('recommendations')} AS re FROM s GROUP BY pred_id)
SELECT pred_id, CASE WHEN f = '' AND im = '' AND re = '' THEN {O.strip('raw')} ELSE f END AS findings, im AS impression, re AS recommendations FROM p"""
# The text between two boxes; its last words are the label.
_SPLIT = r"\[\d+,\s*\d+,\s*\d+,\s*\d+\]"
ORACLE["submit_box_labels"] = rf"""WITH {O.OUT}, h AS (SELECT pred_id, regexp_split_to_array(raw, '{_SPLIT}') AS b, regexp_extract_all(raw, '{_SPLIT}') AS k FROM c WHERE task IN ('detection', 'instance_detection')),
u AS (SELECT pred_id, unnest(k) AS k, b, generate_subscripts(k, 1) AS i FROM h)
SELECT pred_id, (i - 1)::INT AS pos, coalesce(nullif({O.strip(r"regexp_extract(b[i], '(\w+[\w\s]*)\s*:?\s*$', 1)")}, ''), 'abnormality') AS label, regexp_replace(k, '[\[\]\s]', '', 'g') AS box FROM u"""
ORACLE["instance_versions"] = f"""WITH {O.INST}, b4 AS (SELECT model, len(pb) > 0 AND len(rb) > 0 AND len(list_filter(list_concat(pb, rb), lambda x: len(x) <> 4)) > 0 AS broken FROM n)
SELECT model, CASE WHEN bool_or(broken) THEN 'v1_original_only' ELSE 'v2' END AS metrics_version, count(*) FILTER (broken) AS n_broken FROM b4 GROUP BY model"""

_LABEL, _LABELS, _BOXES = O.choice_of("t"), O.labels_of("t"), O.boxes_of("t")
ORACLE["prediction_details"] = rf"""WITH {O.PAIRS}, d AS (SELECT *, CASE task WHEN 'counting' THEN ({O.count_of('t')})::DOUBLE WHEN 'regression' THEN {O.measure_of('t')} END AS number,
  CASE task WHEN 'counting' THEN floor({O.ref_number('ref')}) WHEN 'regression' THEN {O.ref_number('ref')} END AS wanted FROM c)
SELECT d.pred_id, d.question, p.Answer AS model_output, q.Answer AS reference, task NOT IN ('counting', 'regression') OR (number IS NOT NULL AND wanted IS NOT NULL) AS valid_for_metrics,
  CASE task WHEN 'classification' THEN {_LABEL} WHEN 'multi-label' THEN array_to_string({_LABELS}, '; ')
    WHEN 'detection' THEN coalesce(array_to_string(list_transform({_BOXES}, lambda b: array_to_string(b, ',')), ';'), '')
    WHEN 'instance_detection' THEN CASE WHEN starts_with(t, '{{') AND ends_with(t, '}}') AND json_valid(t) THEN regexp_replace(t, '\s+', '', 'g') ELSE '{{}}' END
    WHEN 'counting' THEN number::VARCHAR WHEN 'regression' THEN number::VARCHAR WHEN 'report_generation' THEN {O.strip('t')} END AS parsed_output
FROM d JOIN predictions p ON p.pred_id = d.pred_id JOIN questions q ON q.rec_id = p.rec_id"""


# Packed values: leftmost, then longest known values, between marks that divide or quote.
def _bare(x: str) -> str:
    joined = rf"regexp_replace(lower({x}), '([\p{{L}}\p{{N}}])(?:\\?[''’]|'''')([\p{{L}}\p{{N}}])', '\1\2', 'g')"
    return rf"trim(regexp_replace(regexp_replace({joined}, '[\"''`“”„‘’«»\\]+', ' ', 'g'), '\s+', ' ', 'g'))"


ORACLE["p5_found"] = rf"""WITH t AS (SELECT p, min(term) AS term FROM (SELECT term, {_bare('term')} AS p FROM label_terms) GROUP BY p),
e AS (SELECT '\b(?:' || string_agg(regexp_escape(p) || CASE WHEN regexp_matches(p, '\w$') THEN '\b' ELSE '' END, '|' ORDER BY length(p) DESC, p) || ')' AS e FROM t),
x AS (SELECT rec_id, regexp_extract_all({_bare('Answer')}, e) AS v FROM questions, e WHERE {O.category_of('TaskType')} = 'multi label classification' AND Answer IS NOT NULL),
y AS (SELECT rec_id, unnest(v) AS p, generate_subscripts(v, 1) AS pos FROM x)
SELECT rec_id, pos, term AS val FROM y JOIN t USING (p)"""
# Every value of the tables is a known one.
ORACLE["p5_values"] = ORACLE["p5_found"].replace("term AS val", "term AS val, true AS known")
