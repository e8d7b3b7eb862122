"""The same results in ANSI SQL, for checking against another engine.

Each query is a chain of common table expressions over the given tables.
Rounding uses ``printf``, which rounds the exact binary value half to even.
"""

from __future__ import annotations

from stratalens.functions.features import (
    ANTIPATTERN_FEATURES, INDICATOR_LAYERS, QUALITY_FEATURES, SIZE_LIMITS,
)
from stratalens.functions.text import CUT_MARKER
from stratalens.operators import requests as rq
from stratalens.operators import review as rv
from stratalens.operators.parts import PART_FILES
from stratalens.schema import DEPENDENCY_COLS, SIGNAL_COLS
from stratalens.sources.catalog import UNKNOWN_DESCRIPTION, UNKNOWN_RECOMMENDATION, rows

NL = "chr(10)"


def q(value: object) -> str:
    """SQL literal."""
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def r0(x: str) -> str:
    return f"printf('%.0f', {x})"


def r1(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


def r2(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def exact(x: str, bits: int) -> str:
    """Sum of doubles, rounded once: added as whole multiples of 2^-bits."""
    scale = f"{2.0 ** bits:.0f}e0"
    return f"CAST(CAST(sum(CAST({x}*{scale} AS HUGEINT)) AS VARCHAR) AS DOUBLE)/{scale}"


def label(x: str) -> str:
    return (f"CASE WHEN {x}>=90 THEN 'Excellent' WHEN {x}>=75 THEN 'Good' "
            f"WHEN {x}>=60 THEN 'Fair' WHEN {x}>=40 THEN 'Poor' ELSE 'Critical' END")


def emoji(x: str) -> str:
    return f"CASE WHEN {x}>=75 THEN '🟢' WHEN {x}>=60 THEN '🟠' ELSE '🔴' END"


def display(x: str) -> str:
    return f"({emoji(x)}) || ' ' || ({label(x)}) || ' (' || {r0(x)} || '/100)'"


def rank(x: str) -> str:
    return (f"CASE {x} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 "
            "WHEN 'LOW' THEN 3 WHEN 'NONE' THEN 4 ELSE 5 END")


def penalty(x: str) -> str:
    return (f"CASE {x} WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 "
            "WHEN 'LOW' THEN 2 ELSE 0 END")


CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(q(v) for v in row) + ")" for row in rows()
) + """) AS t(type, severity, impact, usual_layer, display_name, description,
    recommendation, before_code, after_code))"""

RECORDS = """
li AS (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, count(DISTINCT l_suppkey) AS ns,
    count(*) FILTER (l_returnflag='A' AND l_linenumber=1) AS controller_deps,
    count(*) FILTER (l_returnflag='N' AND l_linenumber=2) AS service_deps,
    count(*) FILTER (l_returnflag='R' AND l_linenumber IN (3,4)) AS repository_deps,
    count(*) FILTER (l_returnflag='A' AND l_linenumber=5) AS entity_deps,
    count(*) FILTER (l_returnflag='N' AND l_linenumber=6) AS adapter_deps,
    count(*) FILTER (l_returnflag='N' AND l_linenumber=7) AS port_deps,
    count(*) FILTER (l_returnflag='R' AND l_linenumber=6) AS usecase_deps,
    count(*) FILTER (l_returnflag='R' AND l_linenumber=7) AS gateway_deps,
    count(*) FILTER (l_linestatus='F') AS nf,
    bool_or(l_discount>=0.095) AS hi_disc, bool_or(l_tax>=0.075) AS hi_tax
  FROM lineitem GROUP BY l_orderkey),
rec0 AS (
  SELECT o.o_custkey AS project_id, o.o_orderkey AS file_id,
    CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'mvc' WHEN 'HOUSEHOLD' THEN 'hexagonal'
      WHEN 'FURNITURE' THEN 'clean_architecture' ELSE 'layered' END AS architecture_pattern,
    o.o_orderkey % 10 AS k, o.o_orderstatus AS st, o.o_orderpriority AS pr,
    c.c_nationkey AS nat, c.c_acctbal AS bal, li.*
  FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey
  LEFT JOIN li ON li.l_orderkey=o.o_orderkey),
rec AS (
  SELECT project_id, file_id, 'File' || file_id || '.java' AS file_name, architecture_pattern,
    CASE WHEN k<=2 THEN 'controller' WHEN k<=5 THEN 'service'
      WHEN k=6 THEN CASE architecture_pattern WHEN 'hexagonal' THEN 'port'
        WHEN 'clean_architecture' THEN 'gateway' ELSE 'repository' END
      WHEN k=7 THEN 'entity'
      WHEN k=8 THEN CASE architecture_pattern WHEN 'hexagonal' THEN 'adapter'
        WHEN 'clean_architecture' THEN 'usecase' ELSE 'service' END
      ELSE 'unknown' END AS layer,
    0.6e0 + (project_id % 40) * 0.01e0 AS architecture_confidence,
    CAST(qty*2 AS DOUBLE) AS loc, CAST(n*2 AS DOUBLE) AS methods,
    CAST(CASE WHEN n IS NOT NULL THEN 1 END AS DOUBLE) AS classes,
    1.0e0 + ns*0.25e0 AS avg_cc, CAST(n*4 AS DOUBLE) AS imports, CAST(n*3 AS DOUBLE) AS annotations,
    controller_deps::DOUBLE AS controller_deps, service_deps::DOUBLE AS service_deps,
    repository_deps::DOUBLE AS repository_deps, entity_deps::DOUBLE AS entity_deps,
    adapter_deps::DOUBLE AS adapter_deps, port_deps::DOUBLE AS port_deps,
    usecase_deps::DOUBLE AS usecase_deps, gateway_deps::DOUBLE AS gateway_deps,
    (controller_deps+service_deps+repository_deps+entity_deps+adapter_deps+port_deps
      +usecase_deps+gateway_deps)::DOUBLE AS total_cross_layer_deps,
    nf>=3 AS has_business_logic, repository_deps>0 AS has_data_access,
    k<=2 OR (k=9 AND st='F') AS has_http_handling, st<>'F' AS has_validation,
    st='P' AS has_transaction,
    (k<=2 AND repository_deps>0) OR (k>=3 AND k<=5 AND controller_deps>0)
      AS violates_layer_separation,
    hi_disc AND pr='1-URGENT' AS uses_new_keyword, hi_tax AND pr='5-LOW' AS has_broad_catch,
    pr<>'4-NOT SPECIFIED' AS sends, st, nat, bal, l_orderkey IS NOT NULL AS has_lines
  FROM rec0)"""

FILES = RECORDS + f""",
f AS (
  SELECT rec.* EXCLUDE (sends, has_lines),
    row_number() OVER (PARTITION BY project_id ORDER BY file_id) - 1 AS file_seq,
    sends AND d.doc_id IS NOT NULL AS has_source,
    0.5e0 + (file_id % 50) * 0.01e0 AS confidence
  FROM rec LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 0) d
    ON d.doc_id = file_id % (SELECT count(*) FROM documents)
  WHERE has_lines),
rl AS (
  SELECT *, file_seq // {PART_FILES} AS part,
    CASE WHEN layer<>'unknown' THEN layer WHEN has_http_handling THEN 'controller'
      WHEN repository_deps>0 AND has_data_access THEN 'service'
      WHEN has_data_access THEN 'repository' ELSE 'service' END AS resolved_layer,
    CASE WHEN has_http_handling THEN 'controller'
      WHEN repository_deps>0 AND has_data_access THEN 'service'
      WHEN has_data_access THEN 'repository' ELSE 'service' END AS blind_layer,
    3*violates_layer_separation::INT + 2*has_business_logic::INT + (1-has_validation::INT)
      + 0.5e0*least(total_cross_layer_deps, 5) AS vs
  FROM f)"""


def rule_case(layer: str, new: str = "uses_new_keyword") -> str:
    lm = "architecture_pattern IN ('layered','mvc')"
    hx = "architecture_pattern='hexagonal'"
    cl = "architecture_pattern='clean_architecture'"
    return f"""CASE WHEN {new} THEN 'tight_coupling_new_keyword'
  WHEN has_broad_catch THEN 'broad_catch'
  WHEN {lm} AND {layer}='controller' AND repository_deps>0 THEN 'layer_skip_in_layered'
  WHEN {lm} AND {layer}='service' AND controller_deps>0 THEN 'reversed_dependency_in_layered'
  WHEN {cl} AND {layer}='controller' AND repository_deps+entity_deps>0 THEN 'outer_depends_on_inner_clean'
  WHEN {hx} AND {layer}='adapter' AND port_deps=0 THEN 'adapter_without_port_hexagonal'
  WHEN {hx} AND {layer}='service' AND repository_deps>0 AND has_data_access THEN 'missing_port_adapter_in_hexagonal'
  WHEN {cl} AND {layer} IN ('service','usecase') AND repository_deps>0 AND gateway_deps=0 THEN 'missing_gateway_interface_clean'
  WHEN {hx} AND {layer}='service' AND annotations>=12 THEN 'framework_dependency_in_domain_hexagonal'
  WHEN {cl} AND {layer} IN ('service','usecase') AND annotations>=12 THEN 'usecase_framework_coupling_clean'
  WHEN {cl} AND {layer}='entity' AND annotations>=12 THEN 'entity_framework_coupling_clean'
  WHEN {lm} AND {layer}='controller' AND has_business_logic THEN 'business_logic_in_controller_layered'
  WHEN {lm} AND {layer}='service' AND has_data_access AND NOT has_transaction THEN 'missing_transaction_in_layered'
  WHEN {layer}='controller' AND has_http_handling AND NOT has_validation THEN 'no_validation'
  ELSE 'clean' END"""


ISSUES = [
    ("violates_layer_separation", "'Layer separation violation'"),
    ("layer='controller' AND has_business_logic", "'Business logic in controller'"),
    ("layer='controller' AND NOT has_validation AND has_http_handling", "'Missing input validation'"),
    ("layer='controller' AND repository_deps>0", "'Direct repository access (layer skip)'"),
    ("layer='service' AND has_data_access AND NOT has_transaction", "'Missing @Transactional'"),
    ("layer='service' AND controller_deps>0", "'Reverse dependency on Controller'"),
    ("layer='entity' AND methods>5", "'Entity too complex (>5 methods)'"),
    ("layer='entity' AND has_business_logic", "'Business logic in entity'"),
    ("total_cross_layer_deps>5", "'High cross-layer deps (' || total_cross_layer_deps::BIGINT || ')'"),
    ("imports>30", "'High import count (' || imports::BIGINT || ')'"),
    ("loc>300", "'Large file (' || loc::BIGINT || ' LOC)'"),
]
ISSUE_TEXT = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in ISSUES) + ")"
ISSUE_COUNT = "CAST(" + " + ".join(f"({c})::INT" for c, _ in ISSUES) + " AS BIGINT)"


def scored(name: str, source: str) -> str:
    """Scored rows of a file relation that has ``resolved_layer`` and ``vs``."""
    return f""",
{name}0 AS (
  SELECT *, {rule_case('resolved_layer')} AS type,
    {r1('greatest(0e0, least(100e0, 100e0 - 8e0*vs))')} AS quality_score,
    {ISSUE_TEXT} AS issues, {ISSUE_COUNT} AS n_issues
  FROM {source}),
{name} AS (SELECT * FROM {name}0)"""


SCORED = FILES + scored("s", "rl")

# Part groups, project state, verdict replies and their reading.
GROUPS = SCORED + f""",
g AS (
  SELECT project_id, type, part, count(*) AS n_files,
    list_sort(list(DISTINCT resolved_layer)) AS layers, {exact('confidence', 60)} AS conf,
    min(file_seq) AS first_seq, max(file_seq) AS last_seq,
    count(*) FILTER (has_source) AS n_src, arg_min(architecture_pattern, file_seq) AS arch
  FROM s GROUP BY ALL),
p AS (
  SELECT project_id, bool_or(n_src>0) AS any_source,
    bool_or(n_src>0) AND bool_or(type<>'clean') AS attempted, arg_min(arch, first_seq) AS arch,
    max(last_seq) AS last_seq
  FROM g GROUP BY ALL)"""


def wrapped(json: str, form: str) -> str:
    return (f"CASE {form} WHEN 0 THEN {json} WHEN 1 THEN '```json' || {NL} || {json} || {NL} || '```' "
            f"WHEN 2 THEN 'My answer: ' || {json} || ' That is all.' ELSE 'no answer {{' END")


def object_of(text: str) -> str:
    """JSON object of a reply: fences dropped, else outermost braces."""
    body = f"trim(regexp_replace({text}, '(^|\\n)```[^\\n]*', '', 'g'), chr(10))"
    span = f"regexp_extract({body}, '\\{{.*\\}}', 0, 's')"
    return (f"CASE WHEN json_valid({body}) THEN {body} "
            f"WHEN {span} <> '' AND json_valid({span}) THEN {span} END")


_VERDICT_JSON = """('{"is_valid": ' || CAST((nat + length(type)) % 5 <> 0 AS VARCHAR)
  || ', "reasoning": "seen in ' || n_files || ' files", "description": '
  || CASE WHEN (nat + length(type)) % 5 <> 0 THEN '"found ' || type || '"' ELSE '""' END
  || ', "recommendation": ' || CASE WHEN length(type) % 2 = 0 THEN '"repair ' || type || '"' ELSE '""' END
  || ', "before_code": ' || CASE WHEN length(type) % 3 = 0 THEN '"old();"' ELSE '""' END
  || ', "after_code": ' || CASE WHEN length(type) % 3 <> 1 THEN '"fresh();"' ELSE '""' END
  || ', "severity": ' || CASE WHEN length(type) % 4 = 0 THEN '"HIGH"' ELSE '""' END || '}')"""

VERDICT_REPLIES = GROUPS + f""",
vr0 AS (
  SELECT g.project_id, type, part, {wrapped(_VERDICT_JSON, 'nat % 4')} AS reply
  FROM (SELECT g.*, c.c_nationkey AS nat FROM g JOIN customer c ON c.c_custkey=g.project_id
        WHERE c.c_acctbal >= 0 AND type<>'clean') g),
vr AS (SELECT *, {object_of('reply')} AS obj FROM vr0)"""


def field(name: str, obj: str = "obj") -> str:
    return f"json_extract_string({obj}, '$.{name}')"


APPLIED = VERDICT_REPLIES + f""",
{CAT},
vg AS (
  SELECT g.*, p.any_source, p.attempted, p.arch AS project_arch,
    attempted AND type<>'clean' AND n_src>0 AS asked,
    attempted AND type<>'clean' AND n_src>0 AND obj IS NOT NULL AS backed, obj
  FROM g JOIN p USING (project_id) LEFT JOIN vr USING (project_id, type, part)),
va AS (
  SELECT vg.* EXCLUDE (obj),
    NOT backed OR {field('is_valid')} = 'true' AS is_valid,
    CASE WHEN backed AND {field('severity')} <> '' THEN {field('severity')}
      ELSE coalesce(cat.severity, 'UNKNOWN') END AS severity,
    CASE WHEN backed THEN {field('reasoning')} WHEN asked THEN {q(rv.NO_REPLY_REASON)}
      WHEN attempted AND type<>'clean' THEN {q(rv.NO_SOURCE_REASON)} ELSE '' END AS reasoning,
    CASE WHEN backed THEN {field('description')} ELSE '' END AS description,
    CASE WHEN backed THEN {field('recommendation')} ELSE '' END AS recommendation,
    CASE WHEN backed THEN {field('before_code')} ELSE '' END AS before_code,
    CASE WHEN backed THEN {field('after_code')} ELSE '' END AS after_code
  FROM vg LEFT JOIN cat USING (type)),
stt AS (
  SELECT s.*, va.is_valid, va.backed, va.severity, va.any_source, va.attempted
  FROM s JOIN va USING (project_id, type, part)),
cand AS (
  SELECT * FROM stt WHERE type='clean' AND attempted AND has_source AND confidence < 0.70e0)"""

_CLEAN_JSON = """('{"has_issues": ' || CAST(st='F' AS VARCHAR) || ', "anti_patterns": [{"type": "'
  || CASE WHEN layer='controller' THEN 'layer_skip_in_layered' ELSE 'layer_skip' END
  || '", "severity": "' || CASE WHEN loc>250 THEN 'HIGH' ELSE 'LOW' END
  || '", "description": "missed in ' || file_name || '", "recommendation": "use a service", '
  || '"before_code": "repo.find();", "after_code": "service.find();"}'
  || CASE WHEN loc>300 THEN ', {"type": "broad_catch", "description": "catches all"}' ELSE '' END
  || ']}')"""


def element(name: str) -> str:
    return f"json_extract_string(obj, '$.anti_patterns[' || pos || '].{name}')"


FOUND = APPLIED + f""",
cr0 AS (SELECT *, {wrapped(_CLEAN_JSON, 'nat % 4')} AS reply FROM cand),
cr AS (SELECT *, {object_of('reply')} AS obj FROM cr0),
cu AS (
  SELECT project_id, file_seq, part, file_name, layer, obj,
    unnest(range(json_array_length(obj, '$.anti_patterns')::BIGINT)) AS pos
  FROM cr WHERE obj IS NOT NULL AND {field('has_issues')} = 'true'),
found AS (
  SELECT project_id, file_seq, part, file_name, layer, pos, {element('type')} AS type,
    coalesce({element('severity')}, 'MEDIUM') AS severity,
    coalesce({element('description')}, '') AS description,
    coalesce({element('recommendation')}, '') AS recommendation,
    coalesce({element('before_code')}, '') AS before_code,
    coalesce({element('after_code')}, '') AS after_code
  FROM cu)"""

DETAILS = FOUND + f""",
m AS (
  SELECT project_id, type, n_files, layers, conf, last_seq, 0 AS origin, first_seq, 0 AS pos,
    severity, backed, description, recommendation, before_code, after_code
  FROM va WHERE type<>'clean' AND is_valid
  UNION ALL
  SELECT project_id, type, 1, [layer], 0e0, file_seq, 1, file_seq, pos,
    severity, true, description, recommendation, before_code, after_code
  FROM found),
mg AS (
  SELECT project_id, type, sum(n_files)::BIGINT AS n_files, sum(conf) AS conf, max(last_seq) AS last_seq,
    list_sort(list_distinct(flatten(list(layers)))) AS layers,
    arg_min({{'o': origin, 'f': first_seq, 'p': pos, 'severity': severity, 'backed': backed,
      'description': description, 'recommendation': recommendation,
      'before': before_code, 'after': after_code}}, [origin, first_seq, pos]) AS v
  FROM m GROUP BY ALL),
d0 AS (
  SELECT mg.project_id, mg.type, n_files, last_seq, v,
    coalesce(nullif(v.severity, ''), cat.severity, 'UNKNOWN') AS severity,
    array_to_string(layers, ', ') AS affected_layer,
    {r2('conf / n_files')} AS confidence, v.backed AS llm_validated,
    coalesce(nullif(v.description, ''), cat.description, {q(UNKNOWN_DESCRIPTION)}) AS description,
    coalesce(nullif(v.recommendation, ''), cat.recommendation, {q(UNKNOWN_RECOMMENDATION)}) AS recommendation,
    coalesce(cat.impact, 0) AS impact
  FROM mg LEFT JOIN cat USING (type)),
d AS (
  SELECT *, row_number() OVER (PARTITION BY project_id
    ORDER BY {rank('severity')}, v.o, v.f, v.p, type) AS position FROM d0),
mem AS (
  SELECT project_id, file_seq, part, file_name, type, 0 AS origin FROM stt
  WHERE type<>'clean' AND is_valid
  UNION ALL SELECT project_id, file_seq, part, file_name, type, 1 FROM found)"""

_ENTRY = """CASE WHEN st<>'P' THEN '"' || file_name || '": ' ||
  CASE WHEN file_id % 11 = 0 THEN '"n/a"' ELSE CAST(file_id * 37 % 121 - 10 AS VARCHAR) END END"""
_ASSESS_JSON = """('{' || CASE WHEN nat % 7 = 0 THEN '' ELSE '"overall_score": ' || nat*4 || ', ' END
  || '"reasoning": "looks fair", "file_scores": {' || entries
  || '}, "strengths": ["layers"], "improvements": ["tests", "names"]}')"""


def assessments(source: str) -> str:
    return f""",
ar0 AS (
  SELECT project_id, part, any_value(nat) AS nat,
    coalesce(string_agg({_ENTRY}, ', ' ORDER BY {_ENTRY}), '') AS entries
  FROM {source} WHERE bal >= 0 GROUP BY ALL),
ar1 AS (SELECT *, {wrapped(_ASSESS_JSON, 'nat % 4')} AS reply FROM ar0),
ar2 AS (SELECT *, {object_of('reply')} AS obj0 FROM ar1),
ar AS (SELECT project_id, part,
    CASE WHEN list_contains(json_keys(obj0), 'overall_score') THEN obj0 END AS obj FROM ar2)"""


HYBRID = DETAILS + assessments("s") + f""",
fs0 AS (
  SELECT project_id, part, obj, unnest(json_keys(obj, '$.file_scores')) AS file_name
  FROM ar WHERE obj IS NOT NULL),
fsc AS (
  SELECT project_id, part, file_name,
    TRY_CAST(json_extract_string(obj, '$.file_scores."' || file_name || '"') AS DOUBLE) AS reply,
    true AS has_reply FROM fs0),
fp AS (
  SELECT found.project_id, file_seq, sum({penalty('d.severity')}) AS pts
  FROM found JOIN d USING (project_id, type) GROUP BY ALL),
h0 AS (
  SELECT stt.*, NOT is_valid AS cleared,
    CASE WHEN type<>'clean' AND is_valid THEN {penalty('severity')} ELSE 0 END + coalesce(pts, 0) AS penalty,
    (type='clean' OR NOT is_valid) AND pts IS NULL AS in_clean_list, reply, has_reply
  FROM stt LEFT JOIN fp USING (project_id, file_seq)
  LEFT JOIN fsc USING (project_id, part, file_name)),
h1 AS (
  SELECT * EXCLUDE (quality_score), quality_score AS model_score,
    CASE WHEN NOT any_source THEN 'ml_only' WHEN has_reply THEN 'hybrid' ELSE 'ml_adjusted' END AS method
  FROM h0),
h2 AS (
  SELECT *, CASE method WHEN 'hybrid' THEN 0.4e0*model_score + 0.6e0*coalesce(reply, model_score)
    WHEN 'ml_adjusted' THEN model_score - penalty + CASE WHEN in_clean_list THEN 5 ELSE 0 END
      + CASE WHEN cleared THEN 3 ELSE 0 END
    ELSE model_score END AS raw FROM h1),
h AS (
  SELECT *, {r1('greatest(0e0, least(100e0, raw))')} AS quality_score FROM h2)"""


def layers(source: str, name: str = "lr") -> str:
    mean = "total / n"
    return f""",
{name}s AS (
  SELECT project_id, layer, count(*) AS n, {exact('quality_score', 56)} AS total, sum(n_issues)::BIGINT AS issues,
    count(*) FILTER (n_issues>0) AS with_issues, sum(loc) AS loc, sum(imports) AS imports,
    sum(total_cross_layer_deps) AS deps, min(file_seq) AS first_seq,
    arg_min(architecture_pattern, file_seq) AS arch
  FROM {source} GROUP BY ALL),
{name}q AS (SELECT project_id, {exact('quality_score', 56)} AS score_sum FROM {source} GROUP BY ALL),
{name}m AS (SELECT *, {mean} AS mean FROM {name}s),
{name} AS (
  SELECT project_id, layer, n AS file_count, {r1('mean')} AS mean_score,
    {label('mean')} AS quality_label, {emoji('mean')} AS quality_emoji,
    {display('mean')} AS quality_display, first_seq,
    row_number() OVER (PARTITION BY project_id ORDER BY {r1('mean')} DESC, first_seq) AS position
  FROM {name}m)"""


def projects(sums: str = "lrs", name: str = "pr") -> str:
    return f""",
{name}0 AS (
  SELECT project_id, arg_min(arch, first_seq) AS architecture_pattern, sum(n)::BIGINT AS n,
    any_value(score_sum) / sum(n)::DOUBLE AS overall, sum(issues)::BIGINT AS issues,
    sum(with_issues)::BIGINT AS with_issues, sum(loc) AS loc, sum(imports) AS imports, sum(deps) AS deps
  FROM {sums} JOIN {sums[:-1]}q USING (project_id) GROUP BY project_id),
{name} AS (
  SELECT project_id, architecture_pattern, n AS total_files_analyzed,
    {r1('overall')} AS overall_score, {label('overall')} AS overall_label,
    {emoji('overall')} AS overall_emoji, {display('overall')} AS overall_display,
    {r1('loc/n')} AS avg_loc, {r1('imports/n')} AS avg_imports, {r2('deps/n')} AS avg_cross_layer_deps,
    with_issues AS files_with_violations, issues AS total_issues_found,
    {r1('least(100e0, overall + issues*1.5e0)')} AS projected_score_after_fixes, overall
  FROM {name}0)"""


def quality_text(layer_rows: str = "lr", project_rows: str = "pr", name: str = "qs") -> str:
    """Best layer first in (mean, first file); the weakest is the last one."""
    return f""",
{name}e AS (
  SELECT project_id, count(*) AS n_layers,
    arg_min(layer || ' (' || {r0('mean_score')} || '/100 ' || quality_emoji || ')', position) AS best,
    arg_max(layer || ' (' || {r0('mean_score')} || '/100 ' || quality_emoji || ')', position) AS worst
  FROM {layer_rows} GROUP BY ALL),
{name} AS (
  SELECT project_id, 'Overall project quality: ' || overall_label || ' (' || {r0('overall')} || '/100)'
    || {NL} || '✅ Strongest layer: ' || best
    || CASE WHEN n_layers>1 THEN {NL} || '⚠️  Weakest layer: ' || worst ELSE '' END
    || {NL} || '📋 ' || total_issues_found || ' issues found across ' || files_with_violations || ' files'
    AS summary
  FROM {project_rows} JOIN {name}e USING (project_id))"""


def violation_text(details: str, project_rows: str = "pr", name: str = "vt") -> str:
    def part(severity: str, mark: str) -> str:
        return (f"CASE WHEN n_{severity.lower()}>0 THEN '  |  {mark} ' || n_{severity.lower()} "
                f"|| ' {severity}' ELSE '' END")

    return f""",
{name}c AS (
  SELECT project_id, sum(n_files)::BIGINT AS total,
    count(*) FILTER (severity='CRITICAL') AS n_critical, count(*) FILTER (severity='HIGH') AS n_high,
    count(*) FILTER (severity='MEDIUM') AS n_medium
  FROM {details} GROUP BY ALL),
{name} AS (
  SELECT project_id, coalesce(total, 0) AS total_violations,
    CASE WHEN total IS NULL THEN '✅ No architectural violations detected in ' || total_files_analyzed || ' files'
    ELSE '⚠️ ' || total || ' violations across ' || total_files_analyzed || ' files'
      || {part('CRITICAL', '🔴')} || {part('HIGH', '🟠')} || {part('MEDIUM', '🟡')} END AS violation_summary
  FROM {project_rows} LEFT JOIN {name}c USING (project_id))"""


ML_DETAILS = SCORED + f""",
{CAT},
md0 AS (
  SELECT project_id, type, count(*) AS n_files, list_sort(list(DISTINCT resolved_layer)) AS layers,
    {exact('confidence', 60)} AS conf, min(file_seq) AS first_seq, max(file_seq) AS last_seq
  FROM s WHERE type<>'clean' GROUP BY ALL),
md AS (
  SELECT md0.*, cat.* EXCLUDE (type), array_to_string(layers, ', ') AS affected_layer,
    {r2('conf / n_files')} AS confidence,
    row_number() OVER (PARTITION BY project_id ORDER BY {rank('severity')}, first_seq) AS position
  FROM md0 JOIN cat USING (type))"""


def cut(code: str, n: int) -> str:
    lines = f"string_split({code}, {NL})"
    count = f"(len({lines}) - CASE WHEN {lines}[-1]='' THEN 1 ELSE 0 END)"
    before, after = CUT_MARKER.split("{n}")
    return (f"CASE WHEN {count}<={n} THEN {code} ELSE array_to_string({lines}[1:{n}], {NL}) "
            f"|| {q(before)} || ({count}-{n}) || {q(after)} END")


SOURCES = """,
src AS (
  SELECT project_id, file_seq, file_name, d.text AS code
  FROM f JOIN documents d ON d.doc_id = file_id % (SELECT count(*) FROM documents) WHERE has_source)"""


def lines(*pieces: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(pieces) + ")"


def sections(order: str) -> str:
    return (f"string_agg('=== ' || file_name || ' ===' || {NL} || {cut('code', 300)}, "
            f"{NL} || {NL} ORDER BY {order})")


def select(prefix: str, body: str) -> str:
    return f"WITH {prefix.strip()}\n{body}"


def _quality_feature(name: str) -> str:
    def size(c: str) -> str:
        limit = SIZE_LIMITS.get(c)
        return c if limit is None else f"least({c}, {limit})"

    special = {
        "import_ratio": f"{size('imports')}/({size('loc')}+1)",
        "annotation_density": f"{size('annotations')}/({size('loc')}+1)",
        "method_density": f"{size('methods')}/({size('loc')}+1)",
        "dep_per_loc": f"total_cross_layer_deps/({size('loc')}+1)",
        "violation_score": "vs",
        "controller_has_repo_dep": "(layer='controller' AND repository_deps>0)",
        "service_missing_tx": "(layer='service' AND has_data_access AND NOT has_transaction)",
        "entity_too_complex": "(layer='entity' AND methods>5)",
        "controller_biz_logic": "(layer='controller' AND has_business_logic)",
    }
    special.update({f"layer_{name_}": f"(layer='{name_}')" for name_ in INDICATOR_LAYERS})
    value = special.get(name, size(name))
    if name in SIGNAL_COLS or value.startswith("(layer"):
        value = f"{value}::INT"
    return f"CAST({value} AS DOUBLE) AS {name}"


def _antipattern_feature(name: str) -> str:
    if name == "layer":
        return "resolved_layer AS layer"
    if name == "layer_arch":
        return "resolved_layer || '_' || architecture_pattern AS layer_arch"
    if name in DEPENDENCY_COLS:
        return f"round(ln(1+{name}), 9) AS {name}"
    return name


_MISSING = ("loc methods classes avg_cc imports annotations controller_deps service_deps "
            "repository_deps entity_deps adapter_deps port_deps usecase_deps gateway_deps "
            "total_cross_layer_deps has_business_logic has_data_access").split()

_AFTER = """,
fa AS (
  SELECT * REPLACE (true AS has_validation, false AS violates_layer_separation,
    CASE WHEN layer='controller' THEN 0 ELSE repository_deps END AS repository_deps,
    layer='service' OR has_transaction AS has_transaction,
    2*has_business_logic::INT + 0.5e0*least(total_cross_layer_deps, 5) AS vs)
  FROM rl)""" + scored("sa", "fa")


def _accuracy(bucket: str, extra: str = "") -> str:
    share = r1("passed*100e0/total")
    return select(FILES + f""",
ca AS (SELECT architecture_pattern, layer, {rule_case('resolved_layer')} AS expected,
    {rule_case('blind_layer')} AS predicted FROM rl),
ac AS (
  SELECT CASE WHEN grouping({bucket})=1 THEN '(all)' ELSE {bucket} END AS bucket,
    count(*) FILTER (expected=predicted) AS passed, count(*) AS total
  FROM (SELECT *, CASE WHEN layer='unknown' THEN 'edge' ELSE architecture_pattern END AS arch_bucket
        FROM ca) GROUP BY ROLLUP ({bucket}))""",
        extra or f"SELECT bucket, passed, total, {share} AS accuracy FROM ac")


def _run(name: str, source: str) -> str:
    return layers(source, f"{name}l") + projects(f"{name}ls", f"{name}p") + f""",
{name}v AS (SELECT project_id, count(*) FILTER (type<>'clean') AS total FROM {source} GROUP BY ALL)"""


FIX_FALLBACK = dict(zip(
    "type severity impact usual_layer display description recommendation before after".split(),
    next(row for row in rows() if row[0] == "clean"),
))

ORACLE: dict[str, str] = {}

ORACLE["payload_files"] = select(FILES, """
SELECT project_id, file_seq, file_name, layer, architecture_pattern, loc, total_cross_layer_deps,
  has_validation, uses_new_keyword FROM f""")
ORACLE["valid_files"] = select(RECORDS, """
SELECT project_id, file_id AS file_seq, loc, imports, has_data_access, has_broad_catch
FROM rec WHERE has_lines""")
ORACLE["rejected_files"] = select(RECORDS, f"""
SELECT project_id, file_id AS file_seq, concat_ws('; ', {', '.join(
    f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in _MISSING)},
  CASE WHEN violates_layer_separation IS NULL THEN 'violates_layer_separation missing' END) AS reasons
FROM rec WHERE NOT has_lines""")
ORACLE["defaulted_files"] = select(RECORDS, """
SELECT file_id, coalesce(nullif(layer, 'unknown'), 'controller') AS layer, coalesce(loc, 0) AS loc,
  coalesce(avg_cc, 1) AS avg_cc, coalesce(total_cross_layer_deps, 0) AS total_cross_layer_deps,
  coalesce(has_business_logic, false) AS has_business_logic,
  coalesce(violates_layer_separation, false) AS violates_layer_separation
FROM rec""")
ORACLE["source_lines"] = select(FILES + SOURCES, f"""
SELECT project_id, file_seq, length(code) AS n_chars, length({cut('code', 10)}) AS shown_chars,
  right({cut('code', 10)}, 40) AS ending FROM src""")
ORACLE["catalog_usage"] = select(FILES + f", {CAT}", f"""
SELECT cat.type, severity, impact::BIGINT AS impact_points, usual_layer, coalesce(n, 0) AS files
FROM cat LEFT JOIN (SELECT {rule_case('resolved_layer')} AS type, count(*) AS n FROM rl GROUP BY ALL) u
  ON u.type=cat.type""")
ORACLE["aligned_features"] = select(FILES, """
SELECT file_id, vs::DOUBLE AS violation_score, least(loc, 1500) AS loc,
  (layer='service')::INT::DOUBLE AS layer_service, 0::DOUBLE AS comment_ratio FROM rl""")
ORACLE["resolved_layers"] = select(FILES, """
SELECT project_id, file_id, layer, resolved_layer FROM rl""")
ORACLE["antipattern_inputs"] = select(FILES, f"""
SELECT file_id, {', '.join(_antipattern_feature(c) for c in ANTIPATTERN_FEATURES)} FROM rl""")
ORACLE["quality_inputs"] = select(FILES, f"""
SELECT file_id, {', '.join(_quality_feature(c) for c in QUALITY_FEATURES)} FROM rl""")
ORACLE["file_issues"] = select(FILES, f"""
SELECT file_id, {ISSUE_TEXT} AS issues, {ISSUE_COUNT} AS n_issues FROM f""")
ORACLE["file_scores"] = select(SCORED, f"""
SELECT project_id, file_seq, layer, quality_score, {label('quality_score')} AS quality_label,
  {emoji('quality_score')} AS quality_emoji, {display('quality_score')} AS quality_display, n_issues
FROM s""")
ORACLE["display_names"] = select(FOUND, """
SELECT type, count(*) AS findings,
  coalesce(any_value(cat.display_name), CASE type WHEN 'layer_skip' THEN 'Layer Skip' END) AS display_name
FROM found LEFT JOIN cat USING (type) GROUP BY type""")
ORACLE["parsed_replies"] = select(VERDICT_REPLIES, f"""
SELECT project_id, type, part, obj IS NOT NULL AS was_read, {field('is_valid')}='true' AS is_valid,
  {field('reasoning')} AS reasoning, {field('description')} AS description,
  {field('severity')} AS severity FROM vr""")
ORACLE["parsed_assessments"] = select(FILES + assessments("rl"), f"""
SELECT project_id, part, obj IS NOT NULL AS was_read, {field('overall_score')} AS overall_score,
  {field('reasoning')} AS reasoning,
  CASE WHEN obj IS NOT NULL THEN 'tests, names' END AS improvements,
  len(json_keys(obj, '$.file_scores'))::BIGINT AS n_scores FROM ar""")

ORACLE["rule_labels"] = select(FILES, f"""
SELECT file_id, {rule_case('resolved_layer')} AS type, 1e0 AS confidence FROM rl""")
ORACLE["violations_by_type"] = select(SCORED, """
SELECT type, count(*) AS files, count(DISTINCT project_id) AS projects
FROM s WHERE type<>'clean' GROUP BY type""")
ORACLE["violation_groups"] = select(ML_DETAILS, """
SELECT project_id, type, n_files, affected_layer AS layers, confidence, first_seq, last_seq FROM md""")
ORACLE["violation_files"] = select(SCORED, """
SELECT project_id, type, part, string_agg(file_name, ', ' ORDER BY file_seq) AS files
FROM s WHERE type<>'clean' GROUP BY ALL""")
ORACLE["clean_file_lists"] = select(SCORED, """
SELECT project_id, part, string_agg(file_name, ', ' ORDER BY file_seq) AS clean_files
FROM s WHERE type='clean' GROUP BY ALL""")
ORACLE["violation_details"] = select(ML_DETAILS, """
SELECT project_id, position, type, severity, affected_layer, confidence, n_files FROM md""")
ORACLE["antipattern_summary"] = select(SCORED, """
SELECT c_custkey AS project_id,
  coalesce(arg_min(architecture_pattern, file_seq), 'unknown') AS architecture_pattern,
  count(file_seq) AS total_files_analyzed, count(*) FILTER (type<>'clean') AS total_violations,
  CASE WHEN count(*) FILTER (type<>'clean') = 0 THEN '✅ No violations in ' || count(file_seq) || ' files'
    ELSE '⚠️ ' || count(*) FILTER (type<>'clean') || ' violations across ' || count(file_seq) || ' files' END AS summary
FROM customer LEFT JOIN s ON project_id=c_custkey GROUP BY c_custkey""")
ORACLE["layer_rollup"] = select(SCORED + layers("s"), "SELECT * FROM lr")
ORACLE["project_rollup"] = select(SCORED + layers("s") + projects(), "SELECT * EXCLUDE (overall) FROM pr")
ORACLE["quality_summary"] = select(
    SCORED + layers("s") + projects() + quality_text(), "SELECT * FROM qs")
ORACLE["worst_files"] = select(SCORED, """
SELECT project_id, file_name, layer, quality_score, issues FROM s""")
ORACLE["violation_summary"] = select(
    ML_DETAILS + layers("s") + projects() + violation_text("md"), "SELECT * FROM vt")

ORACLE["verdicts_applied"] = select(APPLIED, """
SELECT project_id, type, part, attempted, asked, is_valid, backed AS llm_validated, severity,
  reasoning, description, recommendation FROM va WHERE type<>'clean'""")
ORACLE["false_positives"] = select(APPLIED, """
SELECT project_id, file_seq, file_name, type FROM stt WHERE NOT is_valid""")
ORACLE["clean_candidates"] = select(APPLIED, """
SELECT project_id, file_seq, file_name, layer, confidence FROM cand""")
ORACLE["discoveries"] = select(FOUND, """
SELECT project_id, file_seq, type, pos, severity, layer, description FROM found""")
ORACLE["discoveries_merged"] = select(DETAILS, f"""
SELECT project_id, position, type, severity, affected_layer, confidence, n_files, llm_validated,
  v.description AS llm_description,
  CASE WHEN llm_validated AND (v.before<>'' OR v.after<>'') THEN {q(rv.INLINE_FIX[0])}
    || recommendation || {q(rv.INLINE_FIX[1])} || v.before || {q(rv.INLINE_FIX[2])} || v.after
    ELSE '' END AS inline_fix,
  CASE WHEN llm_validated AND (v.before<>'' OR v.after<>'') THEN impact ELSE 0 END::BIGINT AS impact_points
FROM d""")
ORACLE["merged_file_lists"] = select(DETAILS, """
SELECT project_id, type, part, string_agg(file_name, ', ' ORDER BY origin, file_seq) AS files
FROM mem GROUP BY ALL""")
ORACLE["clean_files"] = select(FOUND, """
SELECT project_id, file_seq, file_name FROM stt WHERE (type='clean' OR NOT is_valid)
  AND NOT EXISTS (SELECT 1 FROM found WHERE found.project_id=stt.project_id AND found.file_seq=stt.file_seq)""")
ORACLE["ambiguous_names"] = select(FILES, """
SELECT project_id, layer || (file_id % 7) AS file_name, count(*) AS n_files
FROM f GROUP BY ALL HAVING count(*) > 1""")
ORACLE["hybrid_scores"] = select(HYBRID, f"""
SELECT project_id, file_seq, model_score, quality_score, {label('quality_score')} AS quality_label,
  {display('quality_score')} AS quality_display, method AS scoring_method,
  penalty::BIGINT AS penalty, in_clean_list, cleared FROM h""")
ORACLE["hybrid_overall"] = select(SCORED + assessments("s"), f"""
SELECT project_id, {r1(f"coalesce(0.4e0*mean + 0.6e0*TRY_CAST({field('overall_score')} AS DOUBLE), mean)")} AS overall
FROM (SELECT project_id, {exact('quality_score', 56)}/count(*) AS mean FROM s GROUP BY ALL)
LEFT JOIN ar USING (project_id)""")

_VALIDATION_PROMPT = lines(
    q("Review a predicted anti-pattern against the source."),
    "'Predicted: ' || cat.display_name", "'Type: ' || type", "'Architecture: ' || project_arch",
    "'Layer: ' || affected_layer", f"'Confidence: ' || {r0('confidence*100')} || '%'",
    "'Severity: ' || cat.severity", "'Meaning: ' || cat.description", "''", "sources", "''",
    q("Say whether the source really shows it. If so describe it and fix it with the "
      "names used in the source; if not say why."),
    q(rq.VERDICT_FORMAT),
)
ORACLE["validation_requests"] = select(GROUPS + SOURCES + f""",
{CAT},
vs1 AS (
  SELECT project_id, type, part, count(*) AS n_files, {sections('file_seq')} AS sources
  FROM (SELECT s.project_id, s.type, s.part, src.file_seq, src.file_name, code FROM s
        JOIN src USING (project_id, file_seq) WHERE type<>'clean') GROUP BY ALL),
vq AS (
  SELECT g.project_id, type, g.part, p.arch AS project_arch, array_to_string(layers, ', ') AS affected_layer,
    {r2('conf / g.n_files')} AS confidence, vs1.n_files, sources
  FROM g JOIN p USING (project_id) JOIN vs1 USING (project_id, type, part) WHERE attempted)""", f"""
SELECT project_id, type, part, project_arch AS architecture_pattern, affected_layer, confidence,
  cat.severity, n_files, md5({_VALIDATION_PROMPT}) AS prompt_md5
FROM vq JOIN cat USING (type)""")
_HALF = 2000
ORACLE["validation_slices"] = select(GROUPS + SOURCES + f""",
{CAT},
sec0 AS (
  SELECT s.project_id, s.type, s.part, src.file_seq, '=== ' || src.file_name || ' ===' || {NL} || {cut('code', 300)} AS whole
  FROM s JOIN src USING (project_id, file_seq) WHERE type<>'clean'),
sec AS (
  SELECT * EXCLUDE (whole), CASE WHEN strlen(whole) <= {_HALF} THEN whole
    ELSE substr(whole, 1, {(_HALF - len(rq.SECTION_CUT)) // 4}) || {NL} || {q(rq.SECTION_CUT[1:])} END AS section FROM sec0),
sl AS (
  SELECT *, (coalesce(sum(strlen(section)) OVER (PARTITION BY project_id, type, part ORDER BY file_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_HALF})::BIGINT AS slice FROM sec),
vs1 AS (
  SELECT project_id, type, part, slice, count(*) AS n_files, sum(strlen(section))::BIGINT AS source_bytes,
    string_agg(section, {NL} || {NL} ORDER BY file_seq) AS sources FROM sl GROUP BY ALL),
vq AS (
  SELECT g.project_id, type, g.part, slice, p.arch AS project_arch, array_to_string(layers, ', ') AS affected_layer,
    {r2('conf / g.n_files')} AS confidence, vs1.n_files, source_bytes, sources
  FROM g JOIN p USING (project_id) JOIN vs1 USING (project_id, type, part) WHERE attempted)""", f"""
SELECT project_id, type, part, slice, n_files, source_bytes, true AS fits, md5({_VALIDATION_PROMPT}) AS prompt_md5
FROM vq JOIN cat USING (type)""")

_CLEAN_PROMPT = lines(
    q("This file was predicted free of anti-patterns, with little confidence."),
    "'File: ' || cand.file_name", "'Architecture: ' || architecture_pattern", "'Layer: ' || layer",
    "''", cut("code", 300), "''", q("Look for: " + rq.SHORT_NAMES), q(rq.CLEAN_CHECK_FORMAT),
)
ORACLE["clean_check_requests"] = select(APPLIED + SOURCES, f"""
SELECT project_id, file_seq, layer, md5({_CLEAN_PROMPT}) AS prompt_md5
FROM cand JOIN src USING (project_id, file_seq)""")

_ASSESS_PROMPT = lines(
    q("Assess the quality of a project from these findings."),
    "'Architecture: ' || architecture_pattern", "'Files: ' || n_files",
    f"'Model score: ' || {r0('mean')} || '/100'", "'Confirmed violations: ' || n_violations",
    "'Clean files: ' || n_clean", "'Rejected predictions: ' || n_rejected", "''", "file_lines", "''",
    "coalesce(finding_lines, 'No violations.')", "''", q(rq.GUIDE), q(rq.ASSESSMENT_FORMAT),
)
ORACLE["assessment_requests"] = select(HYBRID + f""",
memd AS (
  SELECT DISTINCT mem.project_id, file_seq, type,
    coalesce(CASE WHEN origin=0 THEN stt.severity END, d.severity) AS severity
  FROM mem JOIN d USING (project_id, type) JOIN stt USING (project_id, file_seq)),
nm AS (
  SELECT project_id, file_seq,
    array_to_string(list_sort(list_distinct(list(type || ' (' || severity || ')'))), ', ') AS names
  FROM memd GROUP BY ALL),
fl AS (
  SELECT project_id, part, string_agg('- ' || file_name || ' (layer: ' || layer || ', model score: '
    || {r0('model_score')} || '/100) ' || coalesce(names, 'clean'), {NL} ORDER BY file_seq) AS file_lines
  FROM h LEFT JOIN nm USING (project_id, file_seq) GROUP BY ALL),
ml AS (
  SELECT project_id, type, part, string_agg(file_name, ', ' ORDER BY origin, file_seq) AS files
  FROM mem GROUP BY ALL),
dl AS (
  SELECT project_id, part, string_agg('- ' || type || ' [' || severity || ']: ' || files
    || CASE WHEN llm_validated THEN ' (reviewed)' ELSE '' END, {NL} ORDER BY position) AS finding_lines
  FROM ml JOIN d USING (project_id, type) GROUP BY ALL),
ct AS (
  SELECT project_id, arg_min(architecture_pattern, file_seq) AS architecture_pattern,
    count(*) AS n_files, count(*) FILTER (in_clean_list) AS n_clean, bool_or(any_source) AS any_source,
    {exact('model_score', 56)}/count(*) AS mean
  FROM h GROUP BY project_id),
cn AS (
  SELECT ct.*, coalesce(nv, 0) AS n_violations, coalesce(nr, 0) AS n_rejected FROM ct
  LEFT JOIN (SELECT project_id, count(*) AS nv FROM d GROUP BY ALL) USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS nr FROM va WHERE NOT is_valid GROUP BY ALL) USING (project_id))""",
f"""
SELECT project_id, fl.part, architecture_pattern, n_files, n_violations, n_clean, n_rejected,
  md5({_ASSESS_PROMPT}) AS prompt_md5
FROM cn JOIN fl USING (project_id) LEFT JOIN dl USING (project_id, part) WHERE any_source""")

_FIX_PROMPT = lines(
    q("Suggest a fix for an anti-pattern."), "'Anti-pattern: ' || display_name",
    "'Architecture: ' || architecture_pattern", "'Layer: ' || affected_layer",
    "'Severity: ' || severity", "'Files:'", "names",
    "CASE WHEN n_files>n_shown THEN '  - and ' || (n_files-n_shown) || ' more' END",
    "'Problem: ' || description", f"CASE WHEN n_sources>0 THEN {NL} || 'Source:' || {NL} || sources END",
    f"{NL} || 'Example before:' || {NL} || before_code || {NL} || 'Example after:' || {NL} || after_code",
    q("Give a recommendation, a short example before and after, and tips."),
)
ORACLE["fix_requests"] = select(ML_DETAILS + SOURCES + f""",
rk AS (
  SELECT s.project_id, type, s.file_seq, s.file_name, architecture_pattern, code,
    row_number() OVER (PARTITION BY s.project_id, type ORDER BY s.file_seq) AS r
  FROM s LEFT JOIN src USING (project_id, file_seq) WHERE type<>'clean'),
sh AS (
  SELECT project_id, type, count(*) AS n_shown, count(code) AS n_sources,
    string_agg('  - ' || file_name, {NL} ORDER BY r) AS names,
    {sections('r')} AS sources FROM rk WHERE r<=5 GROUP BY ALL),
arch AS (SELECT project_id, arg_min(architecture_pattern, file_seq) AS architecture_pattern FROM s GROUP BY ALL)""",
f"""
SELECT project_id, type, architecture_pattern, n_files, n_shown, n_sources,
  md5({_FIX_PROMPT}) AS prompt_md5
FROM md JOIN sh USING (project_id, type) JOIN arch USING (project_id)""")

ORACLE["fixes_static"] = select(ML_DETAILS + """,
vf AS (SELECT project_id, type, part, string_agg(file_name, ', ' ORDER BY file_seq) AS files
  FROM s WHERE type<>'clean' GROUP BY ALL)""", """
SELECT project_id, position, type AS anti_pattern, affected_layer AS layer, severity,
  impact::BIGINT AS impact_points, n_files, part, files, false AS ai_powered
FROM md JOIN vf USING (project_id, type)""")
ORACLE["fixes_with_replies"] = select(DETAILS + """,
fr AS (
  SELECT project_id, type, 'Move it. Files: ' || sum(n_files)::BIGINT AS reply FROM g
  JOIN customer c ON c.c_custkey=g.project_id WHERE c_acctbal>=0 AND type<>'clean' GROUP BY ALL)""", f"""
SELECT d.project_id, position, d.type AS anti_pattern, affected_layer AS layer,
  coalesce(cat.impact, {FIX_FALLBACK['impact']})::BIGINT AS impact_points, n_files,
  coalesce(reply, '') AS ai_fix, reply IS NOT NULL AS ai_powered
FROM d LEFT JOIN cat USING (type) LEFT JOIN fr ON fr.project_id=d.project_id AND fr.type=d.type""")
ORACLE["fix_totals"] = select(ML_DETAILS, """
SELECT project_id, count(*) AS total_fixes FROM md GROUP BY project_id""")

ORACLE["accuracy_by_class"] = _accuracy("expected")
ORACLE["accuracy_by_arch"] = _accuracy("arch_bucket")
ORACLE["class_report"] = _accuracy("expected", (
    "SELECT bucket || ' | ' || passed || '/' || total || ' (' || "
    f"CAST({r1('passed*100e0/total')} AS VARCHAR) || '%)' AS value FROM ac"))
ORACLE["run_delta"] = select(SCORED + _AFTER + _run("b", "s") + _run("a", "sa") + f""",
rd AS (
  SELECT project_id, bp.overall_score AS overall_score_before, bv.total AS total_violations_before,
    bp.files_with_violations AS files_with_violations_before,
    ap.overall_score AS overall_score_after, av.total AS total_violations_after,
    ap.files_with_violations AS files_with_violations_after,
    {r1('ap.overall_score - bp.overall_score')} AS score_delta
  FROM bp JOIN ap USING (project_id) JOIN bv USING (project_id) JOIN av USING (project_id))""", """
SELECT *, total_violations_before - total_violations_after AS violations_removed,
  files_with_violations_before - files_with_violations_after AS files_with_violations_removed,
  CASE WHEN score_delta>0 AND total_violations_after<total_violations_before THEN 'improved'
    WHEN score_delta>0 THEN 'partly improved'
    WHEN score_delta=0 AND total_violations_after=0 THEN 'already clean'
    ELSE 'not improved' END AS outcome FROM rd""")
ORACLE["transitions"] = select(SCORED + _AFTER, f"""
SELECT s.project_id, s.file_seq, s.file_name, s.type AS type_before, s.quality_score AS score_before,
  sa.type AS type_after, sa.quality_score AS score_after,
  CASE WHEN s.type='clean' AND sa.type='clean' THEN 'clean' WHEN sa.type='clean' THEN 'fixed'
    WHEN s.type='clean' THEN 'regression' ELSE 'changed' END AS transition,
  {r1('sa.quality_score - s.quality_score')} AS score_delta
FROM s JOIN sa USING (project_id, file_seq)""")
ORACLE["transitions_changed"] = select(SCORED + _AFTER, f"""
, an AS (
  SELECT project_id, file_name, type, quality_score FROM sa WHERE file_seq % 5 <> 4
  UNION ALL SELECT project_id, 'New' || file_name, type, quality_score
  FROM sa WHERE file_seq % 5 <> 4 AND file_seq % 7 = 3)
SELECT project_id, coalesce(s.file_name, an.file_name) AS file_name, s.type AS type_before,
  s.quality_score AS score_before, an.type AS type_after, an.quality_score AS score_after,
  CASE WHEN s.type IS NULL THEN 'added' WHEN an.type IS NULL THEN 'removed'
    WHEN s.type='clean' AND an.type='clean' THEN 'clean' WHEN an.type='clean' THEN 'fixed'
    WHEN s.type='clean' THEN 'regression' ELSE 'changed' END AS transition,
  {r1('an.quality_score - s.quality_score')} AS score_delta
FROM s FULL JOIN an USING (project_id, file_name)""")
ORACLE["quality_metrics"] = select(FILES, """
SELECT round(sqrt(avg((score-label)*(score-label))), 6) AS rmse, round(avg(abs(score-label)), 6) AS mae,
  round(1 - sum((score-label)*(score-label)) / sum((label-m)*(label-m)), 6) AS r2, count(*) AS n
FROM (SELECT score, label, avg(label) OVER () AS m FROM
  (SELECT 100e0 - 8e0*vs AS score, 100e0 - total_cross_layer_deps*6 - avg_cc*4 AS label FROM rl))""")

_FULL = HYBRID + layers("h") + projects() + quality_text() + violation_text("d") + f""",
flags AS (
  SELECT project_id, bool_or(attempted) AS llm_enhanced, bool_or(any_source) AS any_source,
    count(*) FILTER (NOT is_valid) AS false_positives_filtered FROM va GROUP BY project_id),
ap AS (SELECT project_id, arg_min({field('reasoning')}, part) AS reasoning FROM ar
  WHERE obj IS NOT NULL GROUP BY project_id)"""
ORACLE["full_report"] = select(_FULL, """
SELECT pr.* EXCLUDE (overall), summary AS quality_summary, total_violations, violation_summary,
  llm_enhanced, false_positives_filtered, coalesce(reasoning, '') AS quality_reasoning,
  CASE WHEN reasoning IS NULL THEN '' ELSE 'layers' END AS quality_strengths,
  CASE WHEN reasoning IS NULL THEN '' ELSE 'tests, names' END AS quality_improvements,
  CASE WHEN NOT any_source THEN 'ml_only' WHEN reasoning IS NOT NULL THEN 'hybrid'
    WHEN llm_enhanced THEN 'ml_adjusted' ELSE 'ml_only' END AS scoring_method
FROM pr JOIN qs USING (project_id) JOIN vt USING (project_id) JOIN flags USING (project_id)
LEFT JOIN ap ON ap.project_id=pr.project_id AND any_source""")
ORACLE["full_report_layers"] = select(HYBRID + layers("h"), "SELECT * FROM lr")
ORACLE["full_report_model_only"] = select(
    ML_DETAILS + layers("s") + projects() + quality_text() + violation_text("md"), """
SELECT project_id, overall_score, total_violations, 'ml_only' AS scoring_method,
  false AS llm_enhanced, 0::BIGINT AS false_positives_filtered, violation_summary,
  summary AS quality_summary
FROM pr JOIN qs USING (project_id) JOIN vt USING (project_id)""")
ORACLE["nested_report"] = select(_FULL + """,
nf AS (
  SELECT project_id, part, count(*) AS n_files,
    arg_min(file_name, [quality_score, file_seq]) AS worst_file,
    coalesce(string_agg(file_name, ', ' ORDER BY file_seq) FILTER (in_clean_list), '') AS clean_files
  FROM h GROUP BY ALL),
nl AS (
  SELECT project_id, part, string_agg(layer || ':' || names, ';' ORDER BY layer) AS layer_files
  FROM (SELECT project_id, part, layer, string_agg(file_name, ',' ORDER BY quality_score, file_seq) AS names
        FROM h GROUP BY ALL) GROUP BY ALL),
nm AS (
  SELECT project_id, part, string_agg(type || ':' || names, ';' ORDER BY type) AS lists
  FROM (SELECT project_id, part, type, string_agg(file_name, ',' ORDER BY origin, file_seq) AS names
        FROM mem GROUP BY ALL) GROUP BY ALL)""", """
SELECT project_id, part, overall_score, total_violations,
  (SELECT count(*) FROM lr WHERE lr.project_id=pr.project_id) AS n_layers,
  (SELECT count(*) FROM d WHERE d.project_id=pr.project_id) AS n_anti_patterns,
  n_files, worst_file, clean_files, layer_files, coalesce(lists, '') AS anti_pattern_files
FROM pr JOIN vt USING (project_id) JOIN nf USING (project_id) JOIN nl USING (project_id, part)
LEFT JOIN nm USING (project_id, part)""")
def _checksum(*columns: str) -> str:
    row = "concat_ws('|', " + ", ".join(f"{c}::VARCHAR" for c in columns) + ")"
    return f"sum(('0x' || substr(md5({row}), 1, 8))::BIGINT)::BIGINT"


ORACLE["written_report"] = select(SCORED + layers("s") + projects() + quality_text(), f"""
SELECT 'projects' AS table_name, count(*) AS row_count, {_checksum('project_id', 'overall_score', 'summary')} AS checksum
FROM pr JOIN qs USING (project_id)
UNION ALL SELECT 'layers', count(*), {_checksum('project_id', 'layer')} FROM lr
UNION ALL SELECT 'files', count(*), {_checksum('project_id', 'file_name', 'layer', 'quality_score')} FROM s""")
ORACLE["stream_scores"] = select(SCORED, f"""
SELECT project_id, file_seq, type, confidence, quality_score,
  {display('quality_score')} AS quality_display, issues FROM s""")
ORACLE["payload_stream_scores"] = select(SCORED, f"""
SELECT project_id, file_name, 'scored' AS outcome, type, quality_score, '' AS reasons FROM s
UNION ALL SELECT project_id, file_name, 'rejected', NULL, NULL, concat_ws('; ', {', '.join(
    f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in _MISSING)},
  CASE WHEN violates_layer_separation IS NULL THEN 'violates_layer_separation missing' END)
FROM rec WHERE NOT has_lines""")

ORACLE["large_projects"] = select(SCORED + f""",
{CAT},
b AS (SELECT project_id % 3 AS pid, type, resolved_layer, confidence, has_source,
    row_number() OVER (PARTITION BY project_id % 3 ORDER BY project_id, file_seq) - 1 AS seq FROM s),
bg AS (
  SELECT pid, type, seq // {PART_FILES} AS part, count(*) AS n, list(DISTINCT resolved_layer) AS layers,
    {exact('confidence', 60)} AS conf, min(seq) AS first_seq, count(*) FILTER (has_source) > 0 AS asked
  FROM b WHERE type<>'clean' GROUP BY ALL),
bv AS (
  SELECT bg.*, CASE WHEN asked THEN (part + length(type)) % 3 <> 0 ELSE true END AS kept,
    CASE WHEN NOT asked THEN cat.severity WHEN part % 2 = 0 THEN 'LOW' ELSE 'CRITICAL' END AS sev
  FROM bg JOIN cat USING (type)),
br AS (SELECT pid, count(*) AS n_rejected FROM (SELECT pid, type FROM bv GROUP BY ALL HAVING NOT bool_or(kept)) GROUP BY pid),
bd AS (
  SELECT pid, type, sum(n)::BIGINT AS n_files, array_to_string(list_sort(list_distinct(flatten(list(layers)))), ', ') AS affected_layer,
    {r2('sum(conf) / sum(n)')} AS confidence, arg_min(sev, {rank('sev')}) AS severity, bool_or(asked) AS llm_validated,
    coalesce(string_agg('part ' || part, chr(10) ORDER BY part) FILTER (asked), '') AS llm_description, min(first_seq) AS first_seq
  FROM bv WHERE kept GROUP BY ALL)""", f"""
SELECT pid AS project_id, row_number() OVER (PARTITION BY pid ORDER BY {rank('severity')}, first_seq, type) AS position,
  type, severity, affected_layer, confidence, n_files, llm_validated, llm_description,
  coalesce(n_rejected, 0) AS n_rejected
FROM bd LEFT JOIN br USING (pid)""")

_HELD = f"""
SELECT file_id, {rule_case('resolved_layer')} AS expected, true AS type_known, true AS confidence_fits,
  true AS score_fits, true AS band_fits"""
ORACLE["saved_models"] = select(FILES, _HELD + ", true AS r2_reached, true AS accuracy_reached FROM rl WHERE file_id % 5 = 0")
ORACLE["saved_models_stream"] = select(FILES, _HELD + " FROM rl WHERE file_id % 5 = 0")
ORACLE["compiled_models"] = select(FILES, f"""
SELECT file_id, {rule_case('resolved_layer')} AS expected, true AS types_agree, true AS confidences_agree,
  true AS scores_agree FROM rl WHERE file_id % 5 = 0""")

_FIX_GIVEN = """,
md2 AS (SELECT * REPLACE (CASE WHEN position=2 THEN 'MEDIUM' ELSE severity END AS severity,
  CASE WHEN position=3 THEN 'unknown' ELSE affected_layer END AS affected_layer),
  count(*) OVER (PARTITION BY project_id) AS n_entries FROM md WHERE project_id % 13 <> 0),
md3 AS (SELECT md2.* REPLACE (position + again * n_entries AS position), sent
  FROM md2, (VALUES (0), (1)) AS a(again), (VALUES (0), (1)) AS b(sent)
  WHERE (again=0 OR project_id % 5 = 0) AND (sent=0 OR project_id % 7 = 0))"""
_GIVEN_ID = "CASE WHEN project_id % 11 <> 0 THEN project_id END AS project_id"
ORACLE["fix_request_rows"] = select(ML_DETAILS + _FIX_GIVEN + """,
fr AS (SELECT project_id, type, 'Move it. Files: ' || n_files AS reply FROM md
  JOIN customer c ON c.c_custkey=project_id WHERE c_acctbal>=0 AND project_id % 11 <> 0),
un AS (SELECT DISTINCT project_id, sent FROM md, (VALUES (0), (1)) AS b(sent)
  WHERE project_id % 13 = 0 AND (sent=0 OR project_id % 7 = 0))""", f"""
SELECT {_GIVEN_ID}, position, type AS anti_pattern, affected_layer AS layer, severity,
  impact::BIGINT AS impact_points, description AS problem, n_files, coalesce(reply, '') AS ai_fix,
  reply IS NOT NULL AS ai_powered, count(*) OVER (PARTITION BY md3.project_id, sent) AS total_fixes
FROM md3 LEFT JOIN fr USING (project_id, type)
UNION ALL SELECT {_GIVEN_ID}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM un""")
ORACLE["fix_request_prompts"] = (
    ORACLE["fix_requests"].replace("md JOIN sh", "md3 JOIN sh").replace("\nrk AS (", _FIX_GIVEN[2:] + ",\nrk AS (")
    .replace("SELECT project_id, type, architecture_pattern, n_files", f"SELECT {_GIVEN_ID}, type, position, architecture_pattern, n_files")
    .replace("LEFT JOIN src USING (project_id, file_seq)", "LEFT JOIN (SELECT * FROM src WHERE project_id % 2 = 0) src USING (project_id, file_seq)"))
ORACLE["cross_validation"] = select(FILES, """
, base AS (SELECT layer, architecture_pattern, file_id % 5 AS fold, 100e0 - 8e0*vs AS label FROM rl),
means AS (SELECT k, layer, architecture_pattern, avg(label) AS p FROM base, range(5) t(k) WHERE fold <> k GROUP BY ALL),
overall AS (SELECT k, avg(label) AS q FROM base, range(5) t(k) WHERE fold <> k GROUP BY ALL),
err AS (
  SELECT k, sqrt(avg((coalesce(p, q)-label)*(coalesce(p, q)-label)) FILTER (fold=k)) AS held,
    sqrt(avg((coalesce(p, q)-label)*(coalesce(p, q)-label)) FILTER (fold<>k)) AS train, count(*) AS n
  FROM base CROSS JOIN overall LEFT JOIN means USING (k, layer, architecture_pattern) GROUP BY k)
SELECT round(avg(held), 6) AS cv_rmse, round(stddev_pop(held), 6) AS cv_std,
  round(avg(held) - avg(train), 6) AS overfit_gap, any_value(n) AS n FROM err""")
