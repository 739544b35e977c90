"""SQL counterparts of most core queries, for a second engine over the same tables."""

from __future__ import annotations

from mossgrid.functions import lexicon, tasks
from mossgrid.functions.answers import BOX, NO_COUNT_YET, SINGLE_BOX, STATED_COUNT
from mossgrid.functions.fields import BLANKS
from mossgrid.functions.prompts import ASSISTANT_MARKS, IMAGE_MARK


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(BLANKS)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def name_of(x: str) -> str:
    return f"translate({strip(f"lower(coalesce({x}, 'classification'))")}, '_-', '  ')"


def category_of(x: str) -> str:
    return f"nullif(translate({strip(f'lower({x})')}, '_-', '  '), '')"


def route_of(n: str) -> str:
    return (
        f"CASE WHEN contains({n}, 'classification') AND (contains({n}, 'multi') OR contains({n}, 'label')) THEN 'multi-label' "
        f"WHEN contains({n}, 'classification') THEN 'classification' "
        f"WHEN contains({n}, 'instance') AND contains({n}, 'detection') THEN 'instance_detection' "
        f"WHEN contains({n}, 'detection') THEN 'detection' WHEN contains({n}, 'counting') THEN 'counting' "
        f"WHEN contains({n}, 'regression') THEN 'regression' "
        f"WHEN contains({n}, 'report') OR contains({n}, 'generation') THEN 'report_generation' ELSE {n} END"
    )


def lookup(table: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def cleaned(x: str) -> str:
    """The texts hold neither chat marks of system nor user; the steps for them are left out."""
    said = (
        f"CASE WHEN contains({x}, 'assistant' || chr(10)) THEN {strip(f"string_split({x}, 'assistant' || chr(10))[-1]")} "
        f"WHEN contains(lower({x}), 'assistant:') THEN {strip(f"regexp_replace({x}, '(?is)^.*assistant:', '')")} ELSE {x} END"
    )
    return f"list_transform([{said}], lambda s: CASE WHEN contains(s, 'Answer:') THEN {strip("string_split(s, 'Answer:')[-1]")} ELSE s END)[1]"


def pieces(x: str, mark: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '{mark}'), lambda p: {strip('p')}), lambda p: p <> '')"


def labels_of(t: str) -> str:
    inside = rf"regexp_extract({t}, '\[([^\]]+)\]', 1)"
    listed = f"list_transform(CASE WHEN contains({inside}, ';') THEN {pieces(inside, ';')} ELSE {pieces(inside, ',')} END, lambda p: trim(p, {lit("'" + '"')}))"
    plain = f"list_filter(list_transform(CASE WHEN contains({t}, ';') THEN {pieces(t, ';')} ELSE {pieces(t, ',')} END, lambda p: trim(p, {lit("'" + '".,;')})), lambda p: p <> '')"
    return f"CASE WHEN {inside} <> '' THEN {listed} WHEN len({plain}) > 0 THEN {plain} ELSE [{strip(t)}] END"


def choice_of(t: str) -> str:
    letter = rf"regexp_extract(upper({t}), '(?:^|[^\p{{L}}\p{{N}}_])([A-E])(?:[.)\s]|$)', 1)"
    last = f"regexp_extract({t}, '([^{BLANKS}]+)[{BLANKS}]*$', 1)"
    return f"trim(CASE WHEN {letter} <> '' THEN {letter} ELSE {last} END, {lit(BLANKS + ".,:'" + '"')})"


def boxes_of(t: str) -> str:
    """Boxes as lists of numbers. Objects in the tables hold boxes of four whole numbers."""
    numbers = lambda hits: rf"list_transform({hits}, lambda h: list_transform(regexp_extract_all(h, '\d+'), lambda v: v::BIGINT))"
    single, any_ = f"regexp_extract_all({t}, {lit(SINGLE_BOX)})", f"regexp_extract_all({t}, {lit(BOX)})"
    return f"CASE WHEN len({single}) > 0 THEN {numbers(single)} ELSE {numbers(any_)} END"


def label_norm(x: str) -> str:
    bare = rf"regexp_replace({strip(f"coalesce({x}, '')")}, '[{BLANKS}]+', ' ', 'g')"
    return rf"CASE WHEN length({bare}) = 1 AND regexp_matches({bare}, '^\p{{L}}$') THEN upper({bare}) ELSE lower({bare}) END"


def measure_of(t: str) -> str:
    return rf"TRY_CAST(coalesce(nullif(regexp_extract({t}, '(-?\d+\.?\d*)\s*%', 1), ''), nullif(regexp_extract({t}, '(-?\d+\.?\d*)', 1), '')) AS DOUBLE)"


NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def count_of(t: str) -> str:
    """Bare numbers after a step or before a list dot don't occur here: no look-around."""
    most = lambda x, p: f"list_max(list_transform(regexp_extract_all({x}, {lit(p)}, 1), lambda v: v::BIGINT))"
    undecided = " OR ".join(f"contains(lower({t}), {lit(p)})" for p in NO_COUNT_YET)
    bare = rf"list_transform(regexp_extract_all({t}, '\d+'), lambda v: v::BIGINT)"
    some = f"list_max(list_filter({bare}, lambda v: v > 10 OR len({bare}) = 1))"
    return f"CASE WHEN NOT ({undecided}) THEN coalesce({', '.join(most(f'lower({t})', p) for p in STATED_COUNT)}, {some}) END"


def ref_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {NUMBER}) THEN TRY_CAST({x} AS DOUBLE) END"


NAME = name_of("p.TaskType")
PAIRS = f"""
e AS (
  SELECT p.pred_id, p.model, {NAME} AS tn, {route_of(NAME)} AS task, p.Question AS question,
         coalesce(p.Answer, '') AS raw, coalesce(q.Answer, '') AS ref
  FROM predictions p JOIN questions q USING (rec_id)),
c AS (SELECT *, {cleaned('raw')} AS t, {cleaned('ref')} AS r FROM e)"""
OUT = f"""
o AS (SELECT p.pred_id, p.model, {route_of(NAME)} AS task, coalesce(p.Answer, '') AS raw FROM predictions p),
c AS (SELECT *, {cleaned('raw')} AS t FROM o)"""


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


IOU = """(CASE WHEN least(a[3], b[3]) < greatest(a[1], b[1]) OR least(a[4], b[4]) < greatest(a[2], b[2]) THEN 0.0 ELSE
  coalesce((least(a[3], b[3]) - greatest(a[1], b[1]))::DOUBLE * (least(a[4], b[4]) - greatest(a[2], b[2])) / nullif(greatest(
    (a[3] - a[1])::DOUBLE * (a[4] - a[2]) + (b[3] - b[1])::DOUBLE * (b[4] - b[2])
    - (least(a[3], b[3]) - greatest(a[1], b[1]))::DOUBLE * (least(a[4], b[4]) - greatest(a[2], b[2])), 0), 0), 0.0) END)"""


def iou(a: str, b: str) -> str:
    return IOU.replace("a[", f"{a}[").replace("b[", f"{b}[")


def matched(p: str, r: str, threshold: str, sign: str = ">") -> str:
    """Greedy one-to-one matches in list order: a fold with the used places as its state."""
    free = f"list_filter(range(1, len({r}) + 1), lambda k: NOT list_contains(u.m, k))"
    best = f"list_max(list_transform({free}, lambda k: {{'i': {iou('w.x', f'({r})[k]')}, 'k': -k}}))"
    take = f"list_transform([{best}], lambda z: CASE WHEN z.i > 0 AND z.i {sign} {threshold} THEN list_append(u.m, -z.k) ELSE u.m END)[1]"
    items = f"list_concat([{{'x': []::BIGINT[], 'm': []::BIGINT[]}}], list_transform({p}, lambda x: {{'x': x, 'm': []::BIGINT[]}}))"
    return f"len(list_reduce({items}, lambda u, w: {{'x': []::BIGINT[], 'm': {take}}}).m)"


def class_sql(select: str) -> str:
    return f"""WITH {PAIRS},
l AS (SELECT model, {label_norm('ref')} AS ref, {label_norm(choice_of('t'))} AS pred FROM c WHERE task = 'classification'),
k AS (SELECT model, label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (
  SELECT model, ref AS label, 1 AS s, 0 AS p, (ref = pred)::INT AS h FROM l
  UNION ALL SELECT model, pred, 0, 1, 0 FROM l) GROUP BY ALL)
{select}"""


INST = f"""{PAIRS},
i AS (SELECT pred_id, model, t, r FROM c WHERE task = 'instance_detection'),
b AS (
  SELECT pred_id, model, side, unnest(json_keys(CASE WHEN json_valid(x) AND starts_with(x, '{{') THEN x ELSE '{{}}' END)) AS inst, x
  FROM (SELECT pred_id, model, 'p' AS side, t AS x FROM i UNION ALL SELECT pred_id, model, 'r', r FROM i)),
v AS (SELECT pred_id, model, side, inst, CAST(json_extract(x, '$."' || inst || '"') AS BIGINT[][]) AS boxes FROM b),
n AS (
  SELECT pred_id, model, inst, coalesce(any_value(boxes) FILTER (side = 'p'), []::BIGINT[][]) AS pb,
         coalesce(any_value(boxes) FILTER (side = 'r'), []::BIGINT[][]) AS rb
  FROM v GROUP BY ALL)"""


def inst_sums(by: str, threshold: str, sign: str = ">") -> str:
    return f"""s AS (
  SELECT {by}, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nr - tp)::BIGINT AS fn
  FROM (SELECT *, {matched('pb', 'rb', threshold, sign)} AS tp, len(pb) AS np, len(rb) AS nr FROM n {', (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold)' if 'threshold' in by else ''})
  GROUP BY ALL)"""


F1 = div("2.0 * tp", "2 * tp + fp + fn")
PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")


def number_sql(task: str, p: str, r: str) -> str:
    return f"""WITH {PAIRS}, n AS (SELECT model, ({p})::DOUBLE AS p, ({r})::DOUBLE AS r FROM c WHERE task = '{task}')
SELECT model, round(coalesce(avg(abs(p - r)), 'inf'::DOUBLE), 6) AS mean_absolute_error,
       round(sqrt(avg((p - r) * (p - r))), 6) AS root_mean_squared_error,
       count(p - r)::DOUBLE AS valid_samples FROM n GROUP BY model"""


REPORTS = f"{PAIRS}, rep AS (SELECT pred_id, model, {strip('t')} AS g, ref AS r FROM c WHERE task = 'report_generation')"


def present(x: str, table: dict[str, list[str]]) -> str:
    """Names of the table with a word in the text; letters, digits and _ border words."""
    rows = ", ".join(
        rf"CASE WHEN regexp_matches({x}, {lit('(?:^|[^\\p{L}\\p{N}_])(?:' + '|'.join(v) + ')(?:$|[^\\p{L}\\p{N}_])')}) THEN {lit(k)} END" for k, v in table.items()
    )
    return f"list_filter([{rows}], lambda k: k IS NOT NULL)"


def efficacy_of(x: str) -> str:
    cases = []
    for name, terms in lexicon.EFFICACY.items():
        for term in terms:
            at = f"instr({x}, {lit(term)})"
            before = f"substr({x}, greatest({at} - 20, 1), {at} - greatest({at} - 20, 1))"
            denied = " OR ".join(f"contains({before}, {lit(n)})" for n in lexicon.EFFICACY_DENIALS)
            cases.append(f"WHEN {at} > 0 AND NOT ({denied}) THEN {lit(name)}")
    return f"CASE {' '.join(cases)} ELSE 'normal' END"


FILES = r"regexp_extract_all(lower(ImageName), '[^/\\\[\]\s\"'',]+\.[a-z0-9]+')"
PATHS = r"""CASE WHEN ImageName IS NULL OR trim(ImageName, {ws}) = '' THEN []::VARCHAR[]
  WHEN starts_with(trim(ImageName, {ws}), '[') THEN list_transform(regexp_extract_all(ImageName, '["'']([^"'']*)["'']', 1), lambda p: trim(replace(p, '\\', '\'), {ws}))
  ELSE [trim(ImageName, {ws})] END""".replace("{ws}", WS)
VALID = "(SELECT dataset, split_dir, lower(regexp_extract(path, '([^/]+)$', 1)) AS file, min(path) AS image FROM image_files WHERE is_valid GROUP BY ALL)"
SPLIT = "CASE split_dir WHEN 'training' THEN 'train' WHEN 'testing' THEN 'test' ELSE 'val' END"
TN = name_of("TaskType")
SECTIONS_G = " + ".join(f"(contains(lower(r), '{s}') AND contains(lower(g), '{s}'))::INT" for s in lexicon.SECTIONS)
SECTIONS_R = " + ".join(f"contains(lower(r), '{s}')::INT" for s in lexicon.SECTIONS)
TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[" + BLANKS + "]+'), lambda w: w <> '')"

ORACLE: dict[str, str] = {
    "task_normalize": f"SELECT {TN} AS task_name, count(*) AS n FROM questions GROUP BY ALL",
    "task_router": f"""SELECT {route_of(TN)} AS task,
  CASE WHEN contains({TN}, 'classification') AND NOT contains({TN}, 'multi') THEN 'classification'
       WHEN contains({TN}, 'multi') AND contains({TN}, 'label') THEN 'multi-label'
       WHEN contains({TN}, 'instance') AND contains({TN}, 'detection') THEN 'instance_detection'
       WHEN contains({TN}, 'detection') THEN 'detection' WHEN contains({TN}, 'counting') THEN 'counting'
       WHEN contains({TN}, 'regression') THEN 'regression'
       WHEN contains({TN}, 'report') OR contains({TN}, 'generation') THEN 'report_generation' ELSE 'default' END AS parser,
  {lookup(tasks.SUBMISSION_KEYS, 'TaskType', 'classification')} AS submission, count(*) AS n FROM questions GROUP BY ALL""",
    "instruction_lookup": f"""WITH q AS (SELECT {TN} AS tn, len({PATHS}) AS k FROM questions),
i AS (SELECT {lookup(tasks.INSTRUCTIONS, 'tn', tasks.DEFAULT_INSTRUCTION)} AS evaluation,
  {lookup(tasks.INSTRUCTIONS | {'report generation': tasks.TRAINING_REPORT_INSTRUCTION}, 'tn', tasks.DEFAULT_INSTRUCTION)} AS t, k FROM q)
SELECT evaluation, CASE WHEN k > 1 THEN replace(replace(t, 'the image', 'the images'), 'this image', 'these images') ELSE t END AS training, count(*) AS n FROM i GROUP BY ALL""",
    "chat_messages": f"""SELECT rec_id, 2 AS n_messages, len({PATHS}) + 1 AS n_parts,
  {lookup(tasks.INSTRUCTIONS, TN, tasks.DEFAULT_INSTRUCTION)} || chr(10) || chr(10) || {strip('Question')} AS text FROM questions WHERE Question IS NOT NULL""",
    "prompt_flatten": f"""SELECT rec_id, '<|im_start|>user' || chr(10) || repeat('{IMAGE_MARK}', greatest(1, len({PATHS}))::BIGINT) || Question || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || coalesce(Answer, '') || '<|im_end|>' AS chat FROM questions WHERE Question IS NOT NULL""",
    "label_mask_ratio": r"""WITH w AS (SELECT rec_id, list_filter(regexp_split_to_array(Question, '\s+'), lambda x: x <> '') AS q, list_filter(regexp_split_to_array(Answer, '\s+'), lambda x: x <> '') AS a
  FROM questions WHERE Question IS NOT NULL AND Answer IS NOT NULL),
m AS (SELECT rec_id, len(q) + len(list_filter(a, lambda x: length(x) = 3)) AS n_masked, len(q) + len(a) AS n FROM w)
SELECT rec_id, n_masked, round((n - n_masked)::DOUBLE / nullif(n, 0), 6) AS ratio FROM m""",
    "image_cap": f"SELECT rec_id, len({PATHS}) AS n_images, least(2, len({PATHS})) AS n_capped FROM questions",
    "training_steps": """WITH n AS (SELECT dataset, floor(count(*) * 3 / 16)::BIGINT AS steps FROM questions WHERE split_dir = 'training' GROUP BY ALL)
SELECT dataset, steps, greatest(10, steps // 100) AS logging FROM n""",
    "clean_output": f"WITH {OUT} SELECT pred_id, t AS text FROM c",
    "parse_classification": f"WITH {OUT} SELECT pred_id, {choice_of('t')} AS label FROM c WHERE task = 'classification'",
    "parse_multilabel": f"WITH {OUT}, l AS (SELECT pred_id, {labels_of('t')} AS l FROM c WHERE task = 'multi-label') SELECT pred_id, len(l) AS n, array_to_string(l, '|') AS labels FROM l",
    "parse_detection": f"""WITH {OUT}, b AS (SELECT pred_id, {boxes_of('t')} AS b FROM c WHERE task = 'detection')
SELECT pred_id, coalesce(array_to_string(list_transform(b, lambda x: array_to_string(x, ',')), ';'), '') AS boxes FROM b""",
    "parse_instance": f"""WITH {OUT}, j AS (SELECT pred_id, CASE WHEN starts_with(t, '{{') AND ends_with(t, '}}') AND json_valid(t) THEN t ELSE '{{}}' END AS t FROM c WHERE task = 'instance_detection')
SELECT pred_id, coalesce(array_to_string(list_sort(json_keys(t)), ','), '') AS names, len(regexp_extract_all(t, {lit(BOX.replace('?', ''))})) AS n_boxes FROM j""",
    "parse_counting": f"WITH {OUT} SELECT pred_id, {count_of('t')} AS count FROM c WHERE task = 'counting'",
    "parse_regression": f"WITH {OUT} SELECT pred_id, {measure_of('t')} AS value FROM c WHERE task = 'regression'",
    "parse_report": f"WITH {OUT} SELECT pred_id, {strip('t')} AS report FROM c WHERE task = 'report_generation'",
    "reference_validity": f"""WITH {PAIRS}, n AS (SELECT pred_id, task, CASE WHEN task = 'counting' THEN ({count_of('t')})::DOUBLE ELSE {measure_of('t')} END AS p, {ref_number('ref')} AS r
  FROM c WHERE task IN ('counting', 'regression'))
SELECT pred_id, CASE WHEN task = 'counting' THEN floor(r) ELSE r END AS r_number, p IS NOT NULL AND r IS NOT NULL AS valid FROM n""",
    "submit_classification": rf"""WITH {OUT}, s AS (SELECT pred_id, {strip('raw')} AS x, lower(raw) AS l FROM c WHERE task = 'classification'),
v AS (SELECT pred_id, x, regexp_extract(x, '(?:^|[^\p{{L}}\p{{N}}_])([A-K])(?:$|[^\p{{L}}\p{{N}}_])', 1) AS a,
  TRY_CAST(coalesce(nullif(regexp_extract(l, '(\d+)%|confidence:?\s*(\d*\.?\d+)', 1), ''), nullif(regexp_extract(l, '(\d+)%|confidence:?\s*(\d*\.?\d+)', 2), '')) AS DOUBLE) AS f FROM s)
SELECT pred_id, CASE WHEN a <> '' THEN a ELSE x END AS answer, CASE WHEN f > 1 THEN f / 100 ELSE f END AS confidence FROM v""",
    "submit_multilabel": rf"""WITH {OUT}, f AS (SELECT pred_id, {strip('raw')} AS x, list_filter(list_transform(string_split({strip('raw')}, chr(10)), lambda l: regexp_replace({strip('l')}, '^[-•*\d.]+\s*', '')), lambda l: length(l) > 3) AS k
  FROM c WHERE task IN ('multi-label', 'report_generation')) SELECT pred_id, CASE WHEN len(k) > 0 THEN array_to_string(k, '; ') ELSE x END AS answer FROM f""",
    "submit_detection": rf"""WITH {OUT}, b AS (SELECT pred_id, {strip('raw')} AS x, list_transform(regexp_extract_all(raw, '\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]'), lambda h: regexp_replace(h, '\s+', '', 'g')) AS k
  FROM c WHERE task IN ('detection', 'instance_detection')) SELECT pred_id, CASE WHEN len(k) > 0 THEN array_to_string(k, '; ') ELSE x END AS answer FROM b""",
    "submit_counting": rf"WITH {OUT} SELECT pred_id, coalesce(TRY_CAST(nullif(regexp_extract(raw, '(\d+)', 1), '') AS BIGINT), 0)::VARCHAR AS answer FROM c WHERE task IN ('counting', 'regression')",
    "submission_prompts": f"""SELECT pred_id, replace(replace({lookup(tasks.SUBMISSION_PROMPTS, lookup(tasks.SUBMISSION_KEYS, 'TaskType', 'classification'), '')}, '{{target}}', 'objects'), '{{question}}', Question) AS prompt
  FROM predictions WHERE Question IS NOT NULL""",
    "prediction_summary": "SELECT coalesce(TaskType, 'Unknown') AS TaskType, count(*) AS n FROM predictions GROUP BY ALL",
    "path_dedup": "SELECT path, arg_min(file_id, (listed_at, file_id)) AS file_id FROM image_files GROUP BY path",
    "prepare_samples": f"""WITH q AS (SELECT rec_id, dataset, split_dir, {PATHS} AS ps FROM questions),
x AS (SELECT rec_id, dataset, split_dir, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM q),
j AS (SELECT x.rec_id, x.i, v.image FROM x LEFT JOIN {VALID} v ON v.dataset = x.dataset AND v.split_dir = x.split_dir AND v.file = {strip(r"lower(regexp_extract(x.p, '([^/\\]*)$', 1))")})
SELECT rec_id, count(image) AS num_images, count(*) - count(image) AS n_skipped, string_agg(image, '|' ORDER BY i) AS images FROM j GROUP BY rec_id HAVING count(image) > 0""",
    "prepare_skipped": f"""WITH x AS (SELECT dataset, split_dir, rec_id, unnest(list_distinct({FILES})) AS file FROM questions)
SELECT x.dataset, count(*) AS n_missing FROM x ANTI JOIN {VALID} v ON v.dataset = x.dataset AND v.split_dir = x.split_dir AND v.file = x.file GROUP BY ALL""",
    "prepare_sampled": """SELECT rec_id, dataset, split_dir FROM questions
QUALIFY row_number() OVER (PARTITION BY dataset, split_dir ORDER BY (rec_id * 2654435761) % 4294967296, rec_id) <= 100""",
    "prepare_firstn": f"WITH {PAIRS} SELECT pred_id, model, task FROM e QUALIFY row_number() OVER (PARTITION BY model, task ORDER BY pred_id) <= 25",
    "dataset_stats": f"SELECT dataset, count(*) FILTER ({SPLIT} = 'train') AS train, count(*) FILTER ({SPLIT} = 'val') AS val, count(*) FILTER ({SPLIT} = 'test') AS test FROM questions GROUP BY dataset",
    "task_distribution": f"SELECT {category_of('TaskType')} AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM questions WHERE split_dir = 'training' GROUP BY ALL",
    "dataset_info": f"""WITH q AS (SELECT {SPLIT} AS s, {category_of('TaskType')} AS t, {category_of('Modality')} AS m FROM questions)
SELECT count(*) FILTER (s = 'train') AS train_samples, count(*) FILTER (s = 'val') AS val_samples, count(*) FILTER (s = 'test') AS test_samples,
  array_to_string(list_sort(list(DISTINCT t) FILTER (s = 'train' AND t IS NOT NULL)), '|') AS task_types,
  array_to_string(list_sort(list(DISTINCT m) FILTER (s = 'train' AND m IS NOT NULL)), '|') AS modalities FROM q""",
    "validation_issues": f"""WITH q AS (SELECT dataset, split_dir, count(*) FILTER (trim(coalesce(Question, '')) = '') AS no_question, count(*) FILTER (trim(coalesce(Answer, '')) = '') AS no_answer,
  count(*) FILTER ({category_of('TaskType')} IS NULL) AS no_task FROM questions GROUP BY ALL),
f AS (SELECT dataset, split_dir, count(*) AS n_files, count(*) FILTER (NOT is_valid) AS n_invalid FROM image_files GROUP BY ALL)
SELECT dataset, split_dir, coalesce(no_question, 0) AS no_question, coalesce(no_answer, 0) AS no_answer, coalesce(no_task, 0) AS no_task, coalesce(n_files, 0) AS n_files, coalesce(n_invalid, 0) AS n_invalid
FROM q FULL JOIN f USING (dataset, split_dir)""",
    "category_datasets": "SELECT category, split_dir, count(*) AS n, count(DISTINCT dataset) AS n_datasets FROM questions JOIN datasets USING (dataset) GROUP BY ALL",
    "cls_accuracy": class_sql(f"SELECT model, round({div('sum(hits)', 'sum(support)')}, 6) AS accuracy, sum(support)::DOUBLE AS valid_samples FROM k GROUP BY model"),
    "cls_balanced_accuracy": class_sql("SELECT model, round(avg(hits / support) FILTER (support > 0), 6) AS balanced_accuracy FROM k GROUP BY model"),
    "cls_f1_weighted": class_sql(f"SELECT model, round({div('sum(2.0 * hits / (support + predicted) * support)', 'sum(support)')}, 6) AS f1_score FROM k GROUP BY model"),
    "cls_distribution": class_sql("SELECT * FROM k"),
    "multilabel_f1": f"""WITH {PAIRS},
l AS (SELECT model, list_distinct(list_transform(list_filter({labels_of('t')}, lambda x: x <> ''), lambda x: {strip('x')})) AS p, list_distinct(list_transform(list_filter({labels_of('r')}, lambda x: x <> ''), lambda x: {strip('x')})) AS r FROM c WHERE task = 'multi-label'),
s AS (SELECT model, {div('len(list_intersect(p, r))', 'len(p)')} AS p, {div('len(list_intersect(p, r))', 'len(r)')} AS r FROM l WHERE len(r) > 0)
SELECT model, round(avg({div('2 * p * r', 'p + r')}), 6) AS f1_score, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, count(*)::DOUBLE AS valid_samples FROM s GROUP BY model""",
    "iou_pairs": f"""WITH {PAIRS}, b AS (SELECT pred_id, {boxes_of('t')} AS p, {boxes_of('r')} AS r FROM c WHERE task = 'detection'),
x AS (SELECT pred_id, p[1] AS a, unnest(r) AS b, generate_subscripts(r, 1) - 1 AS pos FROM b WHERE len(p) > 0)
SELECT pred_id, pos, round({iou('a', 'b')}, 6) AS iou FROM x WHERE round({iou('a', 'b')}, 6) > 0""",
    "detection_f1": f"""WITH {PAIRS}, b AS (SELECT model, {boxes_of('t')} AS p, {boxes_of('r')} AS r FROM c WHERE task = 'detection'),
m AS (SELECT model, {matched('p', 'r', '0.5')} AS tp, len(p) AS np, len(r) AS nr FROM b),
s AS (SELECT model, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nr - tp)::BIGINT AS fn FROM m GROUP BY model)
SELECT model, tp, fp, fn, round({F1}, 6) AS f1_score FROM s""",
    "detection_matches": f"""WITH {PAIRS}, b AS (SELECT pred_id, {boxes_of('t')} AS p, {boxes_of('r')} AS r FROM c WHERE task = 'detection')
SELECT pred_id, {matched('p', 'r', '0.1')} AS tp, len(p) AS n_pred, len(r) AS n_ref FROM b""",
    "instance_f1": f"WITH {INST}, {inst_sums('model', '0.5')} SELECT model, tp, fp, fn, round({F1}, 6) AS f1_score FROM s",
    "instance_sweep": f"WITH {INST}, {inst_sums('model, threshold::DOUBLE AS threshold', 'threshold')} SELECT model, threshold, tp, fp, fn, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall FROM s",
    "instance_per_id": f"WITH {INST}, {inst_sums('model, inst', '0.3', '>=')} SELECT model, inst, tp, fp, fn, round({F1}, 6) AS f1_score FROM s",
    "count_mae_rmse": number_sql("counting", count_of("t"), f"floor({ref_number('ref')})"),
    "regression_mae_rmse": number_sql("regression", measure_of("t"), ref_number("ref")),
    "green_locations": f"""WITH {REPORTS}, l AS (SELECT pred_id, {present('lower(g)', lexicon.LOCATIONS)} AS g, {present('lower(r)', lexicon.LOCATIONS)} AS r FROM rep)
SELECT pred_id, round(CASE WHEN len(r) = 0 THEN (len(g) = 0)::INT ELSE len(list_intersect(r, g))::DOUBLE / len(list_distinct(list_concat(r, g))) END, 6) AS location_accuracy FROM l""",
    "green_temporal": f"""WITH {REPORTS},
l AS (SELECT pred_id, {present('lower(g)', lexicon.TIMES)} AS g, {present('lower(r)', lexicon.TIMES)} AS r,
  len({present('lower(g)', {k: t for k, t, _, _ in lexicon.FINDINGS})}) > 0 AS ge, len({present('lower(r)', {k: t for k, t, _, _ in lexicon.FINDINGS})}) > 0 AS re FROM rep)
SELECT pred_id, round(CASE WHEN len(r) = 0 THEN CASE WHEN len(g) = 0 THEN 1 ELSE 0.5 END
  ELSE 0.5 * len(list_intersect(r, g)) / len(r) + 0.5 * CASE WHEN len(g) > 0 AND ge AND re THEN 0.8 ELSE 0.5 END END::DOUBLE, 6) AS temporal_accuracy FROM l""",
    "green_entity_kinds": f"""WITH {REPORTS},
l AS (SELECT pred_id, {present('lower(g)', {k: t for k, t, _, _ in lexicon.FINDINGS})} AS g, {present('lower(r)', {k: t for k, t, _, _ in lexicon.FINDINGS})} AS r FROM rep)
SELECT pred_id, coalesce(array_to_string(list_sort(list_intersect(r, g)), ','), '') AS matched_kinds, coalesce(array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(g, x))), ','), '') AS missed_kinds,
  coalesce(array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(r, x))), ','), '') AS extra_kinds FROM l""",
    "green_missed_top5": f"""WITH {REPORTS},
l AS (SELECT model, {present('lower(g)', {k: t for k, t, _, _ in lexicon.FINDINGS})} AS g, {present('lower(r)', {k: t for k, t, _, _ in lexicon.FINDINGS})} AS r FROM rep),
k AS (SELECT model, unnest(list_filter(r, lambda x: NOT list_contains(g, x))) AS kind FROM l),
n AS (SELECT model, kind, count(*) AS missed FROM k GROUP BY ALL)
SELECT model, row_number() OVER (PARTITION BY model ORDER BY missed DESC, kind) AS place, kind, missed FROM n QUALIFY place <= 5""",
    "green_structure": f"""WITH {REPORTS}, s AS (SELECT pred_id, ({SECTIONS_G})::DOUBLE / nullif({SECTIONS_R}, 0) AS s, CASE WHEN length(r) = 0 THEN 0.0 ELSE length(g)::DOUBLE / length(r) END AS q FROM rep)
SELECT pred_id, round(0.7 * coalesce(s, 1) + 0.3 * CASE WHEN q < 2 THEN least(1.0, q) ELSE greatest(0.0, 2 - q) END, 6) AS structure_completeness FROM s""",
    "clinical_efficacy": f"""WITH {REPORTS}, k AS (SELECT pred_id, {efficacy_of('lower(g)')} AS generated, {efficacy_of('lower(r)')} AS reference FROM rep)
SELECT *, CASE WHEN generated = reference THEN 1.0 WHEN generated IN ('critical', 'abnormal') AND reference IN ('critical', 'abnormal') THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM k""",
    "word_overlap": f"""WITH {REPORTS}, w AS (SELECT pred_id, g, r, list_distinct({TOKENS.replace('{x}', 'g')}) AS p, list_distinct({TOKENS.replace('{x}', 'r')}) AS q FROM rep)
SELECT pred_id, round(CASE WHEN g <> '' AND r <> '' THEN {div('len(list_intersect(p, q))', 'len(q)')} END, 6) AS share FROM w""",
    "results_overall": f"""WITH {PAIRS}, n AS (SELECT model, task, CASE task WHEN 'counting' THEN ({count_of('t')})::DOUBLE ELSE {measure_of('t')} END AS p, {ref_number('ref')} AS r FROM c),
k AS (SELECT model, task, count(*) AS num_examples, count(*) FILTER (task NOT IN ('counting', 'regression') OR (p IS NOT NULL AND r IS NOT NULL)) AS valid_examples FROM n GROUP BY ALL),
a AS (SELECT * FROM k UNION ALL SELECT model, 'overall', sum(num_examples)::BIGINT, sum(valid_examples)::BIGINT FROM k GROUP BY model)
SELECT *, num_examples - valid_examples AS skipped_examples FROM a""",
}

# The flat chat holds the first mark of the list, so the assistant starts behind it.
ORACLE["assistant_split"] = (
    f"WITH f AS ({ORACLE['prompt_flatten']}) SELECT rec_id, instr(chat, {lit(ASSISTANT_MARKS[0])}) - 1 + {len(ASSISTANT_MARKS[0])} AS start FROM f"
)
ORACLE["instance_coco"] = f"""WITH {INST}, {inst_sums('model, threshold::DOUBLE AS threshold', 'threshold')},
m AS (SELECT model, threshold, {F1} AS f, {PRECISION} AS p, {RECALL} AS r FROM s), k AS (SELECT model, count(*)::DOUBLE AS n FROM i GROUP BY model)
SELECT model, round(coalesce(avg(f), 0), 6) AS average_f1, round(coalesce(avg(p), 0), 6) AS average_precision, round(coalesce(avg(r), 0), 6) AS average_recall,
  round(coalesce(max(f) FILTER (threshold = 0.3), 0), 6) AS f1_score_at_03, round(coalesce(max(f) FILTER (threshold = 0.5), 0), 6) AS f1_score_at_05, any_value(n) AS valid_samples
FROM k LEFT JOIN m USING (model) GROUP BY model"""
ORACLE["path_resolve"] = f"""WITH q AS (SELECT rec_id, dataset, ({PATHS})[1] AS p FROM questions),
f AS (SELECT dataset, lower(regexp_extract(path, '([^/]+)$', 1)) AS file, min(path) AS named FROM image_files GROUP BY ALL)
SELECT rec_id, coalesce(e.path, f.named) AS image FROM q LEFT JOIN (SELECT DISTINCT path FROM image_files) e ON e.path = q.dataset || '/' || q.p
LEFT JOIN f ON f.dataset = q.dataset AND f.file = {strip(r"lower(regexp_extract(q.p, '([^/\\]*)$', 1))")} WHERE p IS NOT NULL"""
_KEY = lookup(tasks.SUBMISSION_KEYS, "TaskType", "classification")
_LETTER = r"regexp_extract(x, '(?:^|[^\p{L}\p{N}_])([A-K])(?:$|[^\p{L}\p{N}_])', 1)"
_LINES = rf"list_filter(list_transform(string_split(x, chr(10)), lambda l: regexp_replace({strip('l')}, '^[-•*\d.]+\s*', '')), lambda l: length(l) > 3)"
_HITS = r"list_transform(regexp_extract_all(raw, '\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]'), lambda h: regexp_replace(h, '\s+', '', 'g'))"
ORACLE["submit_answers"] = rf"""WITH s AS (SELECT pred_id, {_KEY} AS key, coalesce(Answer, '') AS raw, {strip("coalesce(Answer, '')")} AS x FROM predictions)
SELECT pred_id, key, CASE key WHEN 'classification' THEN coalesce(nullif({_LETTER}, ''), x)
  WHEN 'multi_label' THEN CASE WHEN len({_LINES}) > 0 THEN array_to_string({_LINES}, '; ') ELSE x END
  WHEN 'detection' THEN CASE WHEN len({_HITS}) > 0 THEN array_to_string({_HITS}, '; ') ELSE x END
  WHEN 'counting' THEN coalesce(TRY_CAST(nullif(regexp_extract(raw, '(\d+)', 1), '') AS BIGINT), 0)::VARCHAR ELSE x END AS answer FROM s"""
