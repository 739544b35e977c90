"""Rule-based scores of generated reports against references, as Catalyst expressions.

Mentions are found by cutting the text at a term: the lengths of the parts before a cut sum
up to its place. Only terms that occur at all are cut for, so a text costs little more than
the terms in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.functions import lexicon as L

CONTEXT = 50


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(rows: list[dict]) -> str:
    """A literal array of structs."""
    show = lambda v: _quoted(v) if isinstance(v, str) else f"{float(v)}D"
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {show(v)}" for k, v in r.items()) + ")" for r in rows) + ")"


TERMS = _array([{"kind": k, "term": t, "severity": s, "weight": w} for k, ts, s, w in L.FINDINGS for t in ts])
MODIFIERS = _array([{"word": w, "factor": f} for w, f in L.SEVERITIES])
MARKERS = _array([{"word": w, "doubt": 1.0 - f} for w, f in L.CONFIDENCES])
DENIED = _quoted("\\b(" + "|".join(L.NEGATIONS) + ")\\b")


def _size(context: str) -> str:
    cases = [f"nullif(regexp_extract({context}, {_quoted(p)}, 0), '')" for p in L.SIZES]
    return f"coalesce({', '.join(cases)})"


def mentions(text: Column | str) -> Column:
    """Mentions of findings in lower-case text: kind, term, start, severity, doubt, size,
    weight, denied; by kind and term in the lexicon's order."""
    x = text if isinstance(text, str) else text._jc.toString()
    starts = (
        f"get(transform(array(split({x}, concat('\\\\b', e.term, '\\\\b'), -1)), parts -> "
        "transform(if(size(parts) > 1, sequence(1, size(parts) - 1), cast(array() as array<int>)), i -> "
        "aggregate(slice(parts, 1, i), 0, (n, p) -> n + length(p)) + (i - 1) * length(e.term))), 0)"
    )
    context = f"substring({x}, greatest(0, s - {CONTEXT}) + 1, least(length({x}), s + length(e.term) + {CONTEXT}) - greatest(0, s - {CONTEXT}))"
    before = f"substring({x}, greatest(0, s - {CONTEXT}) + 1, s - greatest(0, s - {CONTEXT}))"
    mention = (
        "named_struct('kind', e.kind, 'term', e.term, 'start', s, "
        f"'severity', e.severity * coalesce(get(filter({MODIFIERS}, m -> instr(c, m.word) > 0), 0).factor, 1.0D), "
        f"'doubt', coalesce(get(filter({MARKERS}, m -> instr(c, m.word) > 0), 0).doubt, 0.0D), "
        f"'size', {_size('c')}, 'weight', e.weight, 'denied', {before} rlike {DENIED})"
    )
    return F.expr(
        f"flatten(transform(filter({TERMS}, e -> instr({x}, e.term) > 0), e -> "
        f"flatten(transform({starts}, s -> transform(array({context}), c -> {mention})))))"
    )


def kinds_present(text: str, table: dict[str, list[str]]) -> Column:
    """Names of the table of which some word stands in the lower-case text."""
    rows = _array([{"name": k, "pattern": "\\b(" + "|".join(v) + ")\\b"} for k, v in table.items()])
    return F.expr(f"transform(filter({rows}, e -> {text} rlike e.pattern), e -> e.name)")


def _similar_sizes(a: str, b: str) -> str:
    number = lambda s: f"cast(regexp_extract({s}, '(\\\\d+\\\\.?\\\\d*)', 1) as double)"
    x, y = number(a), number(b)
    diff = f"abs({x} - {y}) / greatest(abs({x}), abs({y}))"
    return (
        f"case when {x} = 0 and {y} = 0 then 1.0D when {diff} < 0.1 then 1.0D when {diff} < 0.2 then 0.8D "
        f"when {diff} < 0.5 then 0.5D else 0.2D end"
    )


def _best(score: str) -> str:
    """Best score of a reference mention m over the generated mentions of its kind."""
    return f"coalesce(array_max(transform(filter(gen_m, g -> g.kind = m.kind), g -> {score})), 0.0D)"


def _mean(items: str, value: str, otherwise: str) -> str:
    return f"if(size({items}) = 0, {otherwise}, aggregate({items}, 0.0D, (a, m) -> a + {value}) / size({items}))"


def scored(df: DataFrame, generated: str, reference: str) -> DataFrame:
    """Adds the components, ``overall``, ``severity_correlation`` and entity details.

    Null texts are read as empty.
    """
    base = df.withColumns(
        {
            "gen": F.lower(F.coalesce(F.col(generated), F.lit(""))),
            "ref": F.lower(F.coalesce(F.col(reference), F.lit(""))),
            "gen_len": F.length(F.coalesce(F.col(generated), F.lit(""))),
            "ref_len": F.length(F.coalesce(F.col(reference), F.lit(""))),
        }
    )
    found = base.withColumns(
        {
            "gen_m": mentions("gen"),
            "ref_m": mentions("ref"),
            "gen_l": kinds_present("gen", L.LOCATIONS),
            "ref_l": kinds_present("ref", L.LOCATIONS),
            "gen_t": kinds_present("gen", L.TIMES),
            "ref_t": kinds_present("ref", L.TIMES),
        }
    )
    match = (
        "if(m.denied = g.denied, 0.4D, 0.0D) + 0.3D * greatest(0.0D, 1 - abs(m.severity - g.severity) / 4) + "
        "0.2D * greatest(0.0D, 1 - abs(m.doubt - g.doubt)) + case when m.size is not null and g.size is not null then "
        f"0.1D * ({_similar_sizes('m.size', 'g.size')}) when m.size is null and g.size is null then 0.1D else 0.0D end"
    )
    denial = "if(m.denied = g.denied, 0.6D, 0.0D) + 0.4D * greatest(0.0D, 1 - 2 * abs(m.doubt - g.doubt))"
    sized = f"if(g.size is null, 0.0D, {_similar_sizes('m.size', 'g.size')})"
    shared = "filter(ref_m, m -> exists(gen_m, g -> g.kind = m.kind))"
    gravity = "m.weight * (1 + m.severity / 4)"
    caught = "exists(gen_m, g -> g.kind = m.kind and g.term = m.term)"
    section = lambda t: f"instr({t}, s) > 0"
    sections = "array(" + ", ".join(_quoted(s) for s in L.SECTIONS) + ")"
    length = "if(ref_len = 0, 0.0D, gen_len / ref_len)"
    parts = {
        "entity_matching": f"if(size(ref_m) = 0, if(size(gen_m) = 0, 1.0D, 0.0D), aggregate(ref_m, 0.0D, (a, m) -> a + m.weight * {_best(match)}) "
        "/ aggregate(ref_m, 0.0D, (a, m) -> a + m.weight))",
        "location_accuracy": "if(size(ref_l) = 0, if(size(gen_l) = 0, 1.0D, 0.0D), "
        "size(array_intersect(ref_l, gen_l)) / size(array_union(ref_l, gen_l)))",
        "negation_handling": _mean(shared, _best(denial), "1.0D"),
        "temporal_accuracy": "if(size(ref_t) = 0, if(size(gen_t) = 0, 1.0D, 0.5D), 0.5D * size(array_intersect(ref_t, gen_t)) / size(ref_t) "
        "+ 0.5D * if(size(gen_t) > 0 and size(gen_m) > 0 and size(ref_m) > 0, 0.8D, 0.5D))",
        "measurement_accuracy": _mean(f"filter({shared}, m -> m.size is not null)", _best(sized), "1.0D"),
        "clinical_significance": f"if(size(ref_m) = 0, 0.0D, aggregate(ref_m, 0.0D, (a, m) -> a + if({caught}, {gravity}, 0.0D)) "
        f"/ aggregate(ref_m, 0.0D, (a, m) -> a + {gravity}))",
        "structure_completeness": f"0.7D * coalesce(try_divide(size(filter({sections}, s -> {section('ref')} and {section('gen')})), "
        f"size(filter({sections}, s -> {section('ref')}))), 1.0D) + 0.3D * if({length} < 2, least(1.0D, {length}), greatest(0.0D, 2 - {length}))",
    }
    pairs = f"transform(filter(ref_m, m -> {caught}), m -> named_struct('r', m.severity, 'g', get(filter(gen_m, g -> g.kind = m.kind and g.term = m.term), 0).severity))"
    out = found.withColumns({k: F.expr(v) for k, v in parts.items()} | {"__pairs": F.expr(pairs)})
    overall = sum((F.col(k) * w for k, w in L.WEIGHTS.items()), F.lit(0.0))
    kinds = lambda c: F.array_distinct(F.transform(c, lambda m: m["kind"]))
    return out.withColumns(
        {
            "overall": overall,
            "severity_correlation": _correlation("__pairs"),
            "ref_entities": F.size("ref_m"),
            "gen_entities": F.size("gen_m"),
            "matched_kinds": F.array_intersect(kinds("ref_m"), kinds("gen_m")),
            "missed_kinds": F.array_except(kinds("ref_m"), kinds("gen_m")),
            "extra_kinds": F.array_except(kinds("gen_m"), kinds("ref_m")),
        }
    ).drop("__pairs", "gen_len", "ref_len")


def _correlation(pairs: str) -> Column:
    """(Pearson + 1) / 2 of the pairs; 0.5 where it isn't defined, 0 without pairs."""
    total = lambda f: f"aggregate({pairs}, 0.0D, (a, p) -> a + {f})"
    n = f"size({pairs})"
    mean_r, mean_g = f"({total('p.r')} / {n})", f"({total('p.g')} / {n})"
    cov = total(f"(p.r - {mean_r}) * (p.g - {mean_g})")
    var_r, var_g = total(f"pow(p.r - {mean_r}, 2)"), total(f"pow(p.g - {mean_g}, 2)")
    flat = f"array_min(transform({pairs}, p -> p.r)) = array_max(transform({pairs}, p -> p.r)) or array_min(transform({pairs}, p -> p.g)) = array_max(transform({pairs}, p -> p.g))"
    return F.expr(
        f"case when {n} = 0 then 0.0D when {flat} then 0.5D else "
        f"(greatest(-1.0D, least(1.0D, {cov} / sqrt({var_r} * {var_g}))) + 1) / 2 end"
    )


def efficacy_category(text: str) -> Column:
    """First category with a term whose first occurrence isn't denied just before it."""
    rows = _array([{"name": c, "term": t} for c, terms in L.EFFICACY.items() for t in terms])
    lower = f"lower(coalesce({text}, ''))"
    before = "substring(x, greatest(0, instr(x, e.term) - 1 - 20) + 1, least(20, instr(x, e.term) - 1))"
    denied = " or ".join(f"instr({before}, {_quoted(d)}) > 0" for d in L.EFFICACY_DENIALS)
    first = f"get(filter({rows}, e -> instr(x, e.term) > 0 and not ({denied})), 0).name"
    return F.expr(f"coalesce(get(transform(array({lower}), x -> {first}), 0), 'normal')")


def efficacy(generated: str, reference: str) -> Column:
    """One for equal categories, a half for critical against abnormal."""
    g, r = efficacy_category(generated), efficacy_category(reference)
    grave = ["critical", "abnormal"]
    return F.when(g == r, 1.0).when(g.isin(grave) & r.isin(grave), 0.5).otherwise(0.0)


def word_overlap(generated: Column, reference: Column) -> Column:
    """Share of the reference's distinct words that the text has; null if a text is empty."""
    tokens = lambda x: F.array_distinct(F.array_remove(F.split(F.lower(x), r"(?U)\s+"), ""))
    g, r = tokens(generated), tokens(reference)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(g, r)), F.size(r)), F.lit(0.0))
    return F.when((generated != "") & (reference != ""), share)
