"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, mixing, quality_rules, secrets, url_filter

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- op1: parts by the gaps and matches of each pattern; weak ones by every other part of the text

NOT_IN_WORD = r"(?<![A-Za-z0-9_])"


def parts_of(kind: str, pattern: str, group: int = 0, least: int = 0) -> str:
    """rid, start, kind, end of the matches of pattern; group and least: drop matches whose group is shorter."""
    index = secrets.KINDS.index(kind) if kind in secrets.KINDS else len(secrets.KINDS)
    lead = "0"
    if pattern.startswith(NOT_IN_WORD):  # no look-behind here: the character before is matched, and taken off again
        pattern = f"(?:^|[^A-Za-z0-9_])({pattern.removeprefix(NOT_IN_WORD)})"
        lead = "length(m) - length(g)"
        group = 1
    p = quoted(pattern)
    return f"""select rid, upto - length(m) + {lead} s, {index} kind, upto e from (
 select rid, m, g, sum(length(gap) + length(m)) over (partition by rid order by i) upto from (
 select rid, unnest(ms) m, unnest(gs) g, unnest(gaps[1:len(ms)]) gap, unnest(range(len(ms))) i from (
 select rid, regexp_extract_all(t, {p}, 0) ms, regexp_extract_all(t, {p}, {group}) gs, string_split_regex(t, {p}) gaps from d)))
 where length(g) >= {least}"""


def op1() -> str:
    base = " union all ".join([parts_of("assign", secrets.ASSIGN, 2, secrets.ASSIGN_MIN), parts_of("access", secrets.ACCESS), parts_of("hex", secrets.HEX)])
    weak = " union all ".join(parts_of(k, p) for k, p in secrets.WEAK.items())
    roles = " ".join(f"when {i} then '{secrets.ROLE[k]}'" for i, k in enumerate(secrets.KINDS))
    needs = " or ".join(
        f"kind = {secrets.KINDS.index(k)} and " + " and ".join(
            f"exists (select 1 from p q where q.rid = p.rid and q.role = '{n}' and q.scope = p.scope and p.s - q.e <= {secrets.REACH} and q.s - p.e <= {secrets.REACH})" for n in ns
        )
        for k, ns in secrets.NEEDS.items()
    )
    named = "list_extract([" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "], kind + 1) || ':' || s || ':' || e"
    listed = f"string_agg({named}, ',' order by s, kind, e)"
    return f"""with d as materialized (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
 base as materialized ({base}), weak as materialized ({weak}),
 breaks as materialized ({parts_of("break", r"\n[ \t\r\x0B\f]*\n")}),
 a as (select * from base union all select * from weak),
 p as materialized (select a.*, case kind {roles} end "role", (select count(*) from breaks b where b.rid = a.rid and b.s < a.s) scope from a),
 found as (select rid, s, kind, e from base union all select rid, s, kind, e from p where {needs}),
 n as (select rid, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex, {listed} j from base group by rid),
 f as (select rid, {listed} j from found group by rid)
 select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(n.j, '')) base_sha256, coalesce(f.j, '') spans
 from d left join n using (rid) left join f using (rid)"""


# ---- op3


def op3() -> str:
    escaped = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    said = "</s>[INST] ok [/INST]"
    return f"""with t as (select conv_id, turn, coalesce("role", '') "role", coalesce(text, '') text from conversations
 union all select -7, 0, 'user', '{said}' union all select -7, 1, 'assistant', '{said}'),
 o as (select *, row_number() over w i, lag("role") over w before from t window w as (partition by conv_id order by turn, "role", text)),
 p as (select *, before is null or before <> "role" as begins from o)
 select conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || text || chr(10), '' order by i)) turns_sha256,
 cast(coalesce(sum(length(text)) filter ("role" = 'assistant'), 0) as bigint) loss_chars,
 sha256(coalesce(string_agg(text, '' order by i) filter ("role" = 'assistant'), '')) loss_sha256,
 cast(sum(length({escaped.format("text")}) + case when begins then length({escaped.format('"role"')}) + {len(chat.START + chat.SEP + chat.END)} else {len(chat.PART)} end) as bigint) formatted_chars,
 count(*) filter (begins) n_messages from p group by conv_id"""


# ---- op4


def op4() -> str:
    q = quality_rules
    return f"""with d as materialized (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
 w as (select rid, unnest(ws) word, unnest(range(len(ws))) i from (select rid, regexp_extract_all(t, '{WORD}') ws from d)),
 x as (select rid, i, word a, lead(word) over o b, lead(word, 2) over o c from w window o as (partition by rid order by i)),
 y as (select rid, i from x where c is not null qualify count(*) over (partition by rid, a, b, c) > 1),
 r as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from y) group by rid),
 l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
 s as materialized (select d.*, len(regexp_extract_all(t, '{WORD}')) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(r.n, 0) n_repeat_words
 from d join l using (rid) left join r using (rid)),
 j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, 100 * n_symbols > {q.MAX_SYMBOL_PCT} * word_chars or 100 * n_dup_lines > {q.MAX_DUP_LINE_PCT} * n_lines soft from s),
 h as (select source, count(*) n, cast(sum(cast(base_failed or soft as integer)) as double) f from j group by source),
 m as (select count(*) k, sum(n) n, sum(f) / sum(n) m, sum(f * f / n) - sum(n) * pow(sum(f) / sum(n), 2) spread, sum(n) - sum(n * n) / sum(n) size from h),
 v as (select *, (spread - (k - 1) * m * (1 - m)) / (size - (k - 1)) var from m),
 g as (select m, greatest(1.0, case when size > k - 1 and var > 0 then least({q.MAX_PRIOR}.0, m * (1 - m) / var) else {q.MAX_PRIOR}.0 end) strength from v),
 rate as (select *, rate - {q.BOUND} * sqrt(rate * (1 - rate) / (total + 1)) > m bad from (select source, m, n + strength total, (f + strength * m) / (n + strength) rate from h, g))
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (bad and soft) kept, soft soft_failed, round(rate, 6) host_rate, bad bad_host
 from j join rate on rate.source is not distinct from j.source"""


# ---- op8: each level's prior is fitted to the level's own counts


def op8(rules: list[tuple[str, str, str]]) -> str:
    u = url_filter
    low, high = u.STRENGTH
    two = ", ".join(quoted(x) for x in u.TWO_LABEL_SUFFIXES)
    parts = """select page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
 regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path from (select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) rest from pages)"""
    last = lambda n: f"array_to_string(l[-{n}:], '.')"

    def level(name: str, counts: str) -> str:
        """Posterior of each row of counts (key, n, bad, above)."""
        return f"""{name}_c as materialized ({counts}),
 {name}_f as (select sum(pow(bad / n - above, 2) * n) spread, sum(above * (1 - above)) chance, sum(above * (1 - above) * (n - 1)) size from {name}_c where n >= 2),
 {name}_p as (select case when (spread - chance) / size > 0 then greatest({low}, least({high}, 1 / ((spread - chance) / size) - 1)) else {high} end prior from {name}_f),
 {name} as materialized (select key, (bad + prior * above) / (n + prior) mean, n + prior strength from {name}_c, {name}_p)"""

    return f"""with p as materialized ({parts}),
 q as materialized (select *, case when {last(2)} in ({two}) then {last(3)} else {last(2)} end dom, case when {last(2)} in ({two}) then {last(2)} else {last(1)} end suf
 from (select *, string_split(host, '.') l from p)),
 rules(h, r, action) as (values {', '.join(f"({quoted(h)}, {quoted(r)}, {quoted(a)})" for h, r, a in rules)}),
 hit as (select page_id, max_by(h || r, length(h || r)) "rule", max_by(action, length(h || r)) action from q join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, r) group by page_id),
 k as (select host, dom, suf, count(*)::double n, sum(cast(quality = 0 or toxic = 1 as integer))::double bad
 from q join labels on labels.doc_id = try_cast(regexp_extract(url, '/(\\d{{1,18}})[^/\\d]*/?(?:[?#].*)?$', 1) as bigint) where (quality = 0 or toxic = 1) is not null group by all),
 a as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) mean, coalesce(sum(n), 0) + 1 strength from k),
 {level("s", "select suf key, sum(n) n, sum(bad) bad, any_value(a.mean) above from k, a group by suf")},
 {level("d", "select dom key, sum(n) n, sum(bad) bad, any_value(s.mean) above from k join s on s.key = suf group by dom")},
 {level("h", "select host key, n, bad, d.mean above from k join d on d.key = dom")},
 b as (select page_id, host, path, coalesce(h.mean, d.mean, s.mean, a.mean) m, coalesce(h.strength, d.strength, s.strength, a.strength) st
 from q left join h on h.key = host left join d on d.key = dom left join s on s.key = suf, a),
 c as (select *, m - {u.BOUND} * sqrt(m * (1 - m) / (st + 1)) bound from b)
 select c.page_id, host, path, "rule", coalesce(action, case when bound > {u.MAX_BAD} then 'block' else 'allow' end) verdict, round(bound, 6) bad_bound from c left join hit using (page_id)"""


# ---- op10: the same ranges by sorting


def op10() -> str:
    rounds, ranges = [], []
    for k in range(mixing.ROUNDS + 1):
        rounds.append(f"""c{k} as (select d.source, d.hash, room, sum(d.size) over (partition by d.source order by d.hash) upto
 from d join r{k} r on r.source is not distinct from d.source where room > 0 and d.hash >= start and d.size <= room),
 r{k + 1} as (select r.source, coalesce(any_value(c.edge), {2**mixing.HASH_BITS}) + 1 start, any_value(room) - coalesce(any_value(c.used), 0) room from r{k} r
 left join (select source, min(hash) filter (upto > room) edge, max(upto) filter (upto <= room) used from c{k} group by source) c on c.source is not distinct from r.source group by r.source)""")
        ranges.append(f"select a.source, a.start low, b.start - 1 high, a.room largest from r{k} a join r{k + 1} b on a.source is not distinct from b.source where a.room > 0")
    return f"""with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) size,
 cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) hash from documents),
 s as (select source, cast(sum(size) as bigint) n, list_extract([5, 2, 1], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)) w from d group by source),
 o as (select *, row_number() over (order by 2.0::double * n / w, source) i from s),
 k as (select *, 1.5::double * sum(n) over () - 2.0::double * coalesce(sum(n) over (order by i rows between unbounded preceding and 1 preceding), 0) rest,
 sum(w) over (order by i rows between current row and unbounded following) ws from o),
 level as (select rest, ws from k where rest * w / ws <= 2.0::double * n order by i limit 1),
 t as (select k.source, n, case when (select rest from level) * w / (select ws from level) > 2.0::double * n then 2.0::double * n else (select rest from level) * w / (select ws from level) end target from k),
 b as (select *, case when n > 0 then cast(floor(target / n) as bigint) else 0 end base from t),
 r0 as (select source, cast(0 as bigint) start, cast(trunc(target - base * n) as bigint) room from b),
 {', '.join(rounds)}, ranges as ({' union all '.join(ranges)})
 select doc_id, size, n source_size, target, case when n > 0 then size * (base + cast(exists (select 1 from ranges g where g.source is not distinct from d.source
 and d.hash >= g.low and d.hash < g.high and d.size <= g.largest) as bigint)) else 0 end taken
 from d join b on b.source is not distinct from d.source"""


def oracle_sql(url_rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op1_secret_scan": op1(), "op3_chat_format": op3(), "op4_quality_rules": op4(), "op8_url_filter": op8(url_rules), "op10_mixing": op10()}
