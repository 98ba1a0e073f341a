"""The same questions in DuckDB SQL.

Building blocks are common table expressions that are put together per query.
"""

from __future__ import annotations

from queries.views import DOC_LINES_SQL, EVENT_LINES_SQL, LOGS_SQL

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NONSENSE = """(strlen(w) > 20 or strlen(w) < 3
  or length(regexp_replace(w, '[^0-9]', '', 'g')) > strlen(w) // 2
  or (strlen(w) > 8 and regexp_full_match(w, '[0-9a-fA-F]+'))
  or length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) < ceil(strlen(w) / 2.0)
  or (strlen(w) >= 12 and len(list_distinct(string_split(w, ''))) * 20 > strlen(w) * 17))"""


def words(line: str, word_filter: bool = True) -> str:
    test = f"not {NONSENSE}" if word_filter else "strlen(w) >= 3"
    tokens = rf"regexp_extract_all(translate({line}, '{UP}', '{LOW}'), '\p{{L}}+')"
    return f"list_filter({tokens}, lambda w: {test})"


def text(line: str, word_filter: bool = True) -> str:
    return f"array_to_string({words(line, word_filter)}, ' ')"


# Document lines with the optional time column.
DOCS = (f"doc_lines as ({DOC_LINES_SQL})", "d as (select *, null::timestamp as ts from doc_lines)")


def ctes(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


LOGS = f"logs as ({LOGS_SQL})"
DOC_LINES = f"doc_lines as ({DOC_LINES_SQL})"
CONTAINERS = """containers as (
  select lang as namespace, source as pod, 'c' || (doc_id % 3) as container, line, i,
    if(i % 5 = 0, 'stderr', 'stdout') as stream, 1704067200 + doc_id * 60 + i as second
  from (select *, unnest(lines) as line, unnest(range(0, len(lines))) as i
        from (select *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as lines from documents)))"""
EVENT_LINES = f"event_lines as ({EVENT_LINES_SQL})"


def templated(view: str, by: str = "", where: str = "true", name: str = "t", word_filter: bool = True) -> list[str]:
    """``<name>_lines`` (distinct lines) and ``<name>`` (ranked templates)."""
    g = f"{by}, " if by else ""
    return [
        f"""{name}_raw as materialized (
  select {g}line, {text('line', word_filter)} as normalized_text, count(*) as occurrences, min(ts) as first_ts
  from {view} where {where} group by {g}line)""",
        f"{name}_lines as (select * from {name}_raw where normalized_text <> '')",
        f"""{name} as materialized (
  select *, row_number() over (order by count desc, normalized_text{', ' + by if by else ''}) as id
  from (select {g}normalized_text, count(*) as count, cast(sum(occurrences) as bigint) as occurrences,
          arg_min(line, (first_ts is null, first_ts, line)) as representative
        from {name}_lines group by {g}normalized_text))""",
    ]


def bigram_sets(source: str, name: str) -> list[str]:
    """Bit strings of the distinct bigrams; ``b`` counts bigrams with repeats."""
    return [
        f"""{name}_tok as (select id, unnest(list_distinct(list_transform(range(1, length(normalized_text)),
  lambda i: substring(normalized_text, i, 2)))) as g from {source})""",
        _bits(source, name, "length(t.normalized_text) - 1"),
    ]


def char_sets(source: str, name: str) -> list[str]:
    """Bit strings of numbered characters: the k-th occurrence of c is (c, k)."""
    return [
        f"""{name}_chars as (select id, unnest(string_split(normalized_text, '')) as c from {source})""",
        f"""{name}_tok as (select id, c || row_number() over (partition by id, c) as g from {name}_chars)""",
        _bits(source, name, "length(t.normalized_text)"),
    ]


def _bits(source: str, name: str, length: str) -> str:
    return f"""{name}_dict as (select g, cast(row_number() over () - 1 as integer) as pos
  from (select distinct g from {name}_tok)),
{name} as materialized (select t.*, {length} as b, strlen(t.normalized_text) as nbytes, s.bits from {source} t
  join (select id, bitstring_agg(pos, 0, 2047) as bits from {name}_tok join {name}_dict using (g) group by id) s
  on s.id = t.id)"""


SCORE = "2.0::double * bit_count(x.bits & y.bits) / (x.b + y.b)"


def close(t: float, metric: str = "dice_bigrams") -> str:
    ratio = f"least(x.nbytes, y.nbytes)::double / greatest(x.nbytes, y.nbytes) >= {t}::double / (2.0 - {t})"
    return f"{SCORE} >= {t}::double" + (f" and {ratio}" if metric == "dice_bigrams" else "")


def edges(t: float, by: str = "", metric: str = "dice_bigrams", name: str = "t") -> list[str]:
    """``<name>_e``: similar pairs of ``<name>``, earlier rank first."""
    sets = bigram_sets if metric == "dice_bigrams" else char_sets
    same = f" and x.{by} is not distinct from y.{by}" if by else ""
    return [
        *sets(name, f"{name}_s"),
        f"""{name}_e as materialized (select x.id as lo, y.id as hi, {SCORE} as similarity
  from {name}_s x join {name}_s y on x.id < y.id{same} where {close(t, metric)})""",
    ]


def walk(mode: str = "first", name: str = "t") -> list[str]:
    """``<name>_m``: every template of ``<name>`` with its leader, by visiting the
    templates that have earlier neighbours one after the other."""
    pick = (
        "arg_min(similarity, lo) as similarity, min(lo) as leader"
        if mode == "first"
        else "max(similarity) as similarity, arg_min(lo, (-similarity, lo)) as leader"
    )
    return [
        f"""{name}_nb as materialized (select hi, list(lo) as nb, row_number() over (order by hi) as i
  from {name}_e group by hi)""",
        f"""{name}_walk(i, absorbed) as (select 0::bigint, []::bigint[] union all
  select n.i, case when len(list_filter(n.nb, lambda x: not list_contains(w.absorbed, x))) > 0
    then list_append(w.absorbed, n.hi) else w.absorbed end
  from {name}_walk w join {name}_nb n on n.i = w.i + 1)""",
        f"""{name}_out as materialized (select unnest(absorbed) as id from
  (select absorbed from {name}_walk order by i desc limit 1))""",
        f"""{name}_led as (select hi as id, {pick} from {name}_e
  where hi in (from {name}_out) and lo not in (from {name}_out) group by hi)""",
        f"""{name}_m as materialized (select t.*, coalesce(l.leader, t.id) as leader,
  coalesce(l.similarity, 1.0::double) as similarity from {name} t left join {name}_led l on l.id = t.id)""",
    ]


def clustered(
    view: str = "logs", t: float = 0.75, by: str = "", mode: str = "first", metric: str = "dice_bigrams",
    where: str = "true", name: str = "t", word_filter: bool = True,
) -> list[str]:
    return [
        *templated(view, by, where, name, word_filter), *edges(t, by, metric, name), *walk(mode, name),
        f"""{name}_c as materialized (select h.{by + ', h.' if by else ''}id as cluster_id, h.representative, h.normalized_text,
  g.count, g.occurrences, g.n_templates from {name} h join (select leader, cast(sum(count) as bigint) as count,
    cast(sum(occurrences) as bigint) as occurrences, count(*) as n_templates from {name}_m group by leader) g
  on g.leader = h.id)""",
    ]


def membership(by: str = "", base: tuple[str, ...] = (LOGS,), **options) -> str:
    g = f"m.{by}, " if by else ""
    return ctes(*base, *clustered(by=by, **options), recursive=True) + f"""
select {g}m.normalized_text, h.normalized_text as leader_text, round(m.similarity, 6) as similarity, m.count
from t_m m join t h on h.id = m.leader"""


def cluster_query(final: str, **options) -> str:
    return ctes(LOGS, *clustered(**options), recursive=True) + final


def pairs_query(
    t: float, metric: str = "dice_bigrams", base: tuple[str, ...] = (LOGS,), view: str = "logs"
) -> str:
    return ctes(*base, *templated(view), *edges(t, metric=metric)) + """
select least(a.normalized_text, b.normalized_text) as left_text,
  greatest(a.normalized_text, b.normalized_text) as right_text, round(e.similarity, 6) as similarity
from t_e e join t a on a.id = e.lo join t b on b.id = e.hi"""


# Consecutive lines of each document as pairs of template texts.
LINE_PAIRS = f"""docs as (select doc_id, unnest(string_split(text, chr(10))) as line,
  generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
normed as materialized (select doc_id, pos, {text('line')} as txt from docs),
pairs as materialized (select distinct x.txt as a, y.txt as b from normed x
  join normed y on x.doc_id = y.doc_id and y.pos = x.pos + 1 where x.txt <> '' and y.txt <> '')"""

_BIG = "list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))"
DICE_PAIRS = ctes(LINE_PAIRS, f"grams as materialized (select a, b, {_BIG.format('a')} as ga, {_BIG.format('b')} as gb from pairs)") + """
select a, b, round(case when len(ga) = 0 and len(gb) = 0 then 1.0::double
  when len(ga) = 0 or len(gb) = 0 then 0.0::double
  else 2.0::double * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) end, 6) as dice_bigrams
from grams"""

# Common characters of each pair, counted as multisets.
CHAR_SCORES = [
    "numbered as materialized (select *, row_number() over () as pid from pairs)",
    "ca as (select pid, unnest(string_split(a, '')) as c from numbered)",
    "cb as (select pid, unnest(string_split(b, '')) as c from numbered)",
    "na as (select pid, c, count(*) as n from ca group by all)",
    "nb as (select pid, c, count(*) as n from cb group by all)",
    "common as (select pid, sum(least(na.n, nb.n)) as n from na join nb using (pid, c) group by pid)",
    "scored as (select a, b, 2.0::double * coalesce(n, 0) / (length(a) + length(b)) as s from numbered left join common using (pid))",
]

CHAR_PAIRS = (
    ctes(LINE_PAIRS, *CHAR_SCORES)
    + "select a, b, round(s, 6) as dice_chars, s >= 0.75::double * 0.75 as char_overlap from scored"
)

SIMILARITY = ctes(LINE_PAIRS, *CHAR_SCORES, f"grams as materialized (select a, b, s, {_BIG.format('a')} as ga, {_BIG.format('b')} as gb from scored)") + """
select a, b, round(case when a = b then 1.0::double
  when least(strlen(a), strlen(b))::double / greatest(strlen(a), strlen(b)) < 0.5::double / 1.5 then 0.0::double
  when strlen(a) > 15 and strlen(b) > 15 and s < 0.5::double * 0.75 then 0.0::double
  else 2.0::double * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) end, 6) as similarity
from grams"""

PODS = """pods as (select distinct r.r_name as namespace, 'supplier-' || cast(s.s_suppkey as varchar) as pod,
  n.n_name as site, case when n.n_nationkey % 2 = 0 then 'web' else 'batch' end as app
  from supplier s join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey)"""

_CLUSTER_COLS = "representative, normalized_text, array_to_string(string_split(normalized_text, ' '), ',') as words, count, occurrences, n_templates"

_SOURCES = """seen as (select distinct m.leader as cluster_id, l.namespace, l.pod, l.container
  from (select distinct line, namespace, pod, container from logs) l join t_lines x on x.line = l.line
  join t_m m on m.normalized_text = x.normalized_text)"""

_REPORT = """
r as (select *, row_number() over (order by count desc, normalized_text) as rank from t_c)
select rank, 0 as section, '' as item, 'Cluster ' || rank || ': (Count: ' || count || ')' as text from r
union all select rank, 1, '', '  Representative: ' || representative from r
union all select rank, 2, '', '  Key words: [' || array_to_string(list_transform(string_split(normalized_text, ' '),
  lambda w: '"' || w || '"'), ', ') || ']' from r
union all select rank, 3, '', '  Sources:' from r
union all select rank, 4, namespace || '/' || pod || '/' || container, '    - ' || namespace || '/' || pod || '/' || container
  from seen join r using (cluster_id)"""

def _assign(mode: str = "first", order: str = "count desc, normalized_text", both: bool = False) -> str:
    old = clustered("logs", where="namespace in ('AFRICA', 'ASIA')", name="o", mode=mode)
    pick = "min(pos) as pos, arg_min(similarity, pos) as similarity"
    if mode == "best":
        pick = "arg_min(pos, (-similarity, pos)) as pos, max(similarity) as similarity"
    new = templated("logs", where="namespace not in ('AFRICA', 'ASIA')", name="n")
    out = ctes(
        LOGS, *old, *new,
        f"heads as (select row_number() over (order by {order}) as pos, * from o_c)",
        "every as (select id, normalized_text from n union all select -pos, normalized_text from heads)",
        *bigram_sets("every", "v"),
        f"""hits as (select y.id, -x.id as pos, case when x.normalized_text = y.normalized_text then 1.0::double
  else {SCORE} end as similarity from v x join v y on x.id < 0 and y.id > 0
  where x.normalized_text = y.normalized_text or ({close(0.75)}))""",
        f"got as (select id, {pick} from hits group by id)",
        "rest as materialized (select row_number() over (order by count desc, normalized_text) as id, n.* exclude (id) from n where id not in (select id from got))",
        *edges(0.75, name="rest"), *walk(mode, name="rest"),
        recursive=True,
    ) + """
select n.normalized_text, h.normalized_text as cluster_text, round(g.similarity, 6) as similarity, n.count, true as existing
from n join got g on g.id = n.id join heads h on h.pos = g.pos
union all
select m.normalized_text, l.normalized_text, round(m.similarity, 6), m.count, false
from rest_m m join rest l on l.id = m.leader"""
    if not both:
        return out
    first = """select 0::bigint as batch, x.normalized_text, h.normalized_text as cluster_text, round(m.similarity, 6) as similarity, x.count, false as existing
from o_m m join o x on x.id = m.id join o h on h.id = m.leader union all """
    at = out.index("select n.normalized_text, h.normalized_text as cluster_text")
    return out[:at] + first + f"select 1, * from ({out[at:]})"


def _merge() -> str:
    one = clustered("logs", where="namespace in ('AFRICA', 'ASIA')", name="p")
    two = clustered("logs", where="namespace not in ('AFRICA', 'ASIA')", name="q")
    return ctes(
        LOGS, *one, *two,
        "every as (select 0 as run, * from p_c union all select 1, * from q_c)",
        """t as materialized (select row_number() over (order by count desc, normalized_text) as id, * from (
  select normalized_text, max(count) as count, arg_min(representative, (-count, representative)) as representative
  from every group by normalized_text))""",
        *edges(0.75), *walk(),
        """moved as (select 0 as run, m.leader as head, m.id from p_m m union all select 1, m.leader, m.id from q_m m)""",
        """placed as (select e.run, e.cluster_id, m.leader from every e join t_m m using (normalized_text))""",
        """member_lines as (select distinct pl.leader, l.line from (
    select 0 as run, m.leader as cluster_id, x.line from p_lines x join p_m m using (normalized_text)
    union all select 1, m.leader, x.line from q_lines x join q_m m using (normalized_text)) l
  join placed pl on pl.run = l.run and pl.cluster_id = l.cluster_id)""",
        """srcs as (select distinct pl.leader, s.namespace, s.pod, s.container from (
    select case when namespace in ('AFRICA', 'ASIA') then 0 else 1 end as run, namespace, pod, container, line from logs) s
  join (select 0 as run, line, m.leader as cluster_id from p_lines x join p_m m using (normalized_text)
    union all select 1, line, m.leader from q_lines x join q_m m using (normalized_text)) l
    on l.run = s.run and l.line = s.line
  join placed pl on pl.run = l.run and pl.cluster_id = l.cluster_id)""",
        recursive=True,
    ) + """
select t.representative, t.normalized_text, c.count, s.n_sources
from (select leader, count(*) as count from member_lines group by leader) c
join (select leader, count(*) as n_sources from srcs group by leader) s using (leader)
join t on t.id = c.leader"""


# Per cluster what its written members and sources add up to; g names the group column.
def _json(by: str = "", where: str = "true") -> str:
    g = f"c.{by}, " if by else ""
    on = f" and l.{by} is not distinct from x.{by}" if by else ""
    seen = f"""seen as (select distinct m.leader as cluster_id, l.namespace, l.pod, l.container
  from (select distinct line, namespace, pod, container from logs where {where}) l join t_lines x on x.line = l.line{on}
  join t_m m on m.normalized_text = x.normalized_text{on.replace("l.", "m.")})"""
    lines = f"""mem as (select m.leader as cluster_id, count(*) as n_members, min(x.line) as first, cast(sum(strlen(x.line)) as bigint) as bytes
  from t_lines x join t_m m on m.normalized_text = x.normalized_text{on.replace("l.", "m.")} group by m.leader)"""
    return ctes(LOGS, *clustered(where=where, by=by), seen, lines, recursive=True) + f"""
select {g}c.representative, c.normalized_text, array_to_string(string_split(c.normalized_text, ' '), ',') as words, c.count,
  mem.n_members, mem.first, mem.bytes, (select count(*) from seen where seen.cluster_id = c.cluster_id) as n_sources
from t_c c join mem on mem.cluster_id = c.cluster_id"""


_WARN = "(contains(lower(line), 'error') or contains(lower(line), 'warn'))"
_EARLY = "namespace in ('AFRICA', 'ASIA')"
_NULLED = f"nulled as (select * replace (case when {_EARLY} then namespace end as namespace) from logs)"


def _labelled() -> str:
    return ctes(
        LOGS, *clustered(where=_EARLY),
        f"w as (select time_bucket(interval '30 days', ts, timestamp '1970-01-01') as window_start, {text('line')} as normalized_text from logs)",
        recursive=True,
    ) + """
select window_start, h.normalized_text as cluster_text, count(*) as templates, cast(sum(n) as bigint) as occurrences
from (select window_start, normalized_text, count(*) as n from w where normalized_text <> '' group by all) w
left join t_m m on m.normalized_text = w.normalized_text left join t h on h.id = m.leader group by all"""


ORACLES: dict[str, str] = {
    "namespace_scope": ctes(LOGS) + "select pod, container, count(*) as lines from logs where namespace = 'ASIA' group by all",
    "input_stats": ctes(LOGS) + "select count(*) as lines, cast(sum(strlen(line)) as bigint) as bytes from logs",
    "contains_any_filter": ctes(LOGS) + """select namespace, pod, container, line from logs
where contains(lower(line), 'error') or contains(lower(line), 'warn')""",
    "filter_stats": ctes(LOGS) + """select count(*) as before, count(*) filter (where k) as after,
  round(count(*) filter (where k)::double / count(*) * 100.0, 6) as percent_retained
from (select contains(lower(line), 'error') or contains(lower(line), 'timeout') as k from logs)""",
    "since_filter": ctes(EVENT_LINES) + """select namespace, count(*) as lines, min(ts) as first_ts from event_lines
where ts >= timestamp '2024-01-30 00:00:00' - interval 132 hour group by namespace""",
    "since_timestamp": ctes(EVENT_LINES) + """select namespace, count(*) as lines, min(ts) as first_ts from event_lines
where ts >= timestamp '2024-01-20 08:30:00' group by namespace""",
    "label_semi_join": ctes(LOGS, PODS) + """select namespace, pod, container, count(*) as lines from logs l
where exists (select 1 from pods p where p.namespace = l.namespace and p.pod = l.pod and p.app = 'web' and p.site <> '')
group by all""",
    "split_lines": ctes(DOC_LINES) + f"""select namespace, pod, container, count(*) as lines from doc_lines
where {text('line')} <> '' group by all""",
    "union_sources": ctes(LOGS, EVENT_LINES, DOC_LINES) + f"""select namespace, count(*) as lines, count(distinct line) as distinct_lines from (
  select namespace, line from logs union all select namespace, line from event_lines
  union all select 'docs', line from doc_lines) where {text('line')} <> '' group by namespace""",
    "missing_sources": ctes(LOGS) + """select 'no log lines' as error, 'pod: ' || pod || ', container: ' || container as location,
  '2024-02-01T00:00:00+00:00' as timestamp from (
  select distinct namespace, pod, container from logs
  except select namespace, pod, container from logs where contains(lower(line), 'error:'))""",
    "words_filtered": ctes(DOC_LINES) + f"select w as word, count(*) as n from (select unnest({words('line')}) as w from doc_lines) group by w",
    "words_unfiltered": ctes(DOC_LINES) + f"select w as word, count(*) as n from (select unnest({words('line', False)}) as w from doc_lines) group by w",
    "nonsense_tokens": f"select w as token, {NONSENSE} as nonsense, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from documents) group by all",
    "normalized_lines": ctes(DOC_LINES) + f"""select line, {text('line')} as filtered, {text('line', False)} as unfiltered
from (select distinct line from doc_lines) where {text('line', False)} <> ''""",
    "bigram_counts": ctes(DOC_LINES, f"x as (select distinct {text('line', False)} as t from doc_lines)") + """
select bigram, count(*) as n from (select unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) as bigram
  from x where t <> '') group by bigram""",
    "dice_pairs": DICE_PAIRS,
    "char_dice_pairs": CHAR_PAIRS,
    "similarity_pairs": SIMILARITY,
    "exact_templates": ctes(LOGS, *templated("logs")) + "select normalized_text, count, occurrences, representative from t",
    "exact_templates_docs": ctes(*DOCS, *templated("d", by="namespace", word_filter=False))
    + "select namespace, normalized_text, count, occurrences, representative from t",
    "similar_pairs_75": pairs_query(0.75),
    "similar_pairs_60": pairs_query(0.6),
    "similar_pairs_chars_90": pairs_query(0.9, "dice_chars"),
    "similar_pairs_docs_75": pairs_query(0.75, base=DOCS, view="d"),
    "cluster_docs_75": membership(base=DOCS, view="d"),
    "cluster_docs_by_language": membership(base=DOCS, view="d", t=0.6, by="namespace", word_filter=False),
    "cluster_first_75": membership(),
    "cluster_best_75": membership(mode="best"),
    "cluster_first_60": membership(t=0.6),
    "cluster_chars_90": membership(t=0.9, metric="dice_chars"),
    "cluster_unfiltered_75": membership(word_filter=False),
    "cluster_by_namespace": membership(by="namespace"),
    "cluster_summary": cluster_query(f"select {_CLUSTER_COLS} from t_c"),
    "cluster_members": cluster_query("""select h.normalized_text, x.line, x.occurrences from t_lines x
join t_m m using (normalized_text) join t h on h.id = m.leader"""),
    "cluster_members_limit": cluster_query("""select h.normalized_text, x.line from (select m.leader, l.line,
  row_number() over (partition by m.leader order by l.line) as k from t_lines l join t_m m using (normalized_text)) x
join t h on h.id = x.leader where k <= 3"""),
    "cluster_sources": cluster_query("""select h.normalized_text, l.namespace, l.pod, l.container, count(*) as occurrences
from logs l join t_lines x on x.line = l.line join t_m m on m.normalized_text = x.normalized_text
join t h on h.id = m.leader group by all"""),
    "cluster_report": ctes(LOGS, *clustered(), _SOURCES, _REPORT.split("select rank, 0")[0].strip(), recursive=True)
    + "select rank, 0" + _REPORT.split("select rank, 0")[1],
    "top_clusters": cluster_query(f"""select row_number() over (order by count desc, normalized_text) as rank, {_CLUSTER_COLS}
from t_c order by count desc, normalized_text limit 10"""),
    "cluster_stats": cluster_query("""select count(*) as clusters, cast(sum(n_templates) as bigint) as templates,
  cast(sum(count) as bigint) as lines, cast(sum(occurrences) as bigint) as occurrences from t_c"""),
    "rare_clusters": cluster_query(f"select {_CLUSTER_COLS} from t_c where count <= 2"),
    "assign_new_lines": _assign(),
    "merge_two_runs": _merge(),
    "json_roundtrip": _json(),
    "json_roundtrip_by_namespace": _json("namespace", _WARN),
    "json_errors": ctes(LOGS) + f"""select 'no log lines' as error, 'pod: ' || pod || ', container: ' || container as location,
  '2024-02-01T00:00:00+00:00' as timestamp from (select distinct namespace, pod, container from logs where {_EARLY})""",
    "members_null_group": ctes(LOGS, _NULLED, *clustered("nulled", by="namespace"), recursive=True) + """
select x.namespace, h.normalized_text, x.line, x.occurrences from t_lines x join t_m m on m.normalized_text = x.normalized_text
  and m.namespace is not distinct from x.namespace join t h on h.id = m.leader""",
    "sources_null_group": ctes(LOGS, _NULLED, *clustered("nulled", by="namespace"), recursive=True) + """
select l.namespace, h.normalized_text, l.pod, l.container, count(*) as occurrences from nulled l
join t_lines x on x.line = l.line and x.namespace is not distinct from l.namespace
join t_m m on m.normalized_text = x.normalized_text and m.namespace is not distinct from x.namespace
join t h on h.id = m.leader group by all""",
    "top_clusters_by_namespace": cluster_query(f"""select row_number() over (order by count desc, normalized_text, cluster_id) as rank,
  namespace, {_CLUSTER_COLS} from t_c order by rank limit 25""", by="namespace"),
    "assign_new_lines_best": _assign("best"),
    "approximate_pairs_75": f"select count(*) as pairs, 0::bigint as wrong, true as enough from ({pairs_query(0.75)})",
    "assign_new_lines_indexed": _assign(),
    "assign_new_lines_indexed_best": _assign("best"),
    "stream_placed_clusters": _assign(order="cluster_id", both=True),
    "stream_distinct_counts": ctes(LOGS, f"w as (select time_bucket(interval '30 days', ts, timestamp '1970-01-01') as window_start, line, {text('line')} as normalized_text from logs)") + """
select window_start, normalized_text, count(distinct line) as count, 2 * count(*) as occurrences from w where normalized_text <> '' group by all""",
    "cluster_docs_best_75": membership(base=DOCS, view="d", mode="best"),
    "similar_pairs_docs_85": pairs_query(0.85, base=DOCS, view="d"),
    "stream_labelled_counts": _labelled(),
    "label_set_terms": ctes(LOGS, PODS) + """select namespace, pod, container, count(*) as lines from logs l
where exists (select 1 from pods p where p.namespace = l.namespace and p.pod = l.pod and p.app <> 'batch'
  and p.site in ('NATION_2', 'NATION_8', 'NATION_12', 'NATION_20')) group by all""",
    "log_files": ctes(DOC_LINES) + """select namespace, pod, 'part' as container, count(*) as lines, cast(sum(strlen(line)) as bigint) as bytes
from doc_lines group by all""",
    "log_files_namespace": ctes(DOC_LINES) + """select namespace, pod, 'main' as container, count(*) as lines,
  cast(sum(strlen(line)) as bigint) as bytes from doc_lines where namespace = 'de' group by all""",
    "container_logs": ctes(CONTAINERS) + """select namespace, pod, container, stream, count(*) as lines,
  cast(sum(strlen(line)) as bigint) as bytes, min(second) as first, max(second) as last
from containers where pod not like '%3' group by all""",
    "container_log_errors": """select distinct 'pod: ' || source || ', container: c' || (doc_id % 3) as location, 'cannot read' as error
from documents where source like '%3' and text is not null""",
    "container_logs_since": ctes(
        CONTAINERS, "c as (select *, make_timestamp(second * 1000000) as ts from containers where namespace = 'es' and pod not like '%3' and second >= 1704085200)",
        *clustered("c"), recursive=True)
    + f"""select {_CLUSTER_COLS}, (select count(distinct (source, doc_id % 3))
  from documents where lang = 'es' and source like '%3' and text is not null) as failed from t_c""",
    "json_logs": """select event_type as namespace, count(*) as lines from events where event_id % 7 <> 0 group by event_type
union all select '(malformed)', count(*) from events where event_id % 7 = 0""",
    "table_scan": """select event_type as namespace, '' as container, count(*) as lines, count(distinct user_id) as pods, max(ts) as last_ts
from events group by event_type""",
    "empty_input": "select 0::bigint as clusters, 0::bigint as templates, 0::bigint as lines, 0::bigint as occurrences, 0 as members",
    "cluster_by_window_no_time": ctes(
        LOGS, "w as (select * replace (case when namespace <> 'ASIA' then ts end as ts), case when namespace <> 'ASIA' then time_bucket(interval '400 days', ts, timestamp '1970-01-01') end as window_start from logs)",
        *clustered("w", by="window_start"), recursive=True)
    + "select cast(window_start as timestamp) as window_start, normalized_text, count, occurrences, n_templates from t_c",
    "analyze_errors": ctes(LOGS, PODS, *clustered(
        where="namespace = 'EUROPE' and ts >= timestamp '1995-06-01 00:00:00' and (contains(lower(line), 'shipment') or contains(lower(line), 'error'))"
        " and exists (select 1 from pods p where p.namespace = logs.namespace and p.pod = logs.pod and p.app = 'web')"), recursive=True)
    + f"select {_CLUSTER_COLS} from t_c",
    "cluster_by_window": ctes(
        LOGS, "w as (select *, time_bucket(interval '400 days', ts, timestamp '1970-01-01') as window_start from logs)",
        *clustered("w", by="window_start"), recursive=True)
    + "select cast(window_start as timestamp) as window_start, normalized_text, representative, count, occurrences, n_templates from t_c",
    "stream_template_counts": ctes(LOGS, f"w as (select time_bucket(interval '30 days', ts, timestamp '1970-01-01') as window_start, {text('line')} as normalized_text from logs)") + """
select window_start, normalized_text, count(*) as occurrences from w where normalized_text <> '' group by all""",
}
