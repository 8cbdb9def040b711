"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from spark_climbs.llm import mixing, multi_index, quality_rules as rules

_WORD = "[^\\x20\\x09-\\x0D]+"


def _positions() -> str:
    """SQL of ``mixing.position`` for ``share`` and ``phase``."""
    phases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        own = [
            f"when share >= cast({before!r} as double) then {t0!r}::double + 2.0::double * (share - {before!r}::double) / "
            f"({w!r}::double + sqrt({w * w!r}::double + {2 * slope!r}::double * (share - {before!r}::double)))"
            for t0, before, w, slope in reversed(mixing._pieces(knots))
        ]
        phases.append(f"when phase = {k} then case {' '.join(own)} end")
    return f"case {' '.join(phases)} end"


def _mixing() -> str:
    weights = ", ".join(f"{w!r}::double" for w in mixing.WEIGHTS)
    return f"""
    with docs as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
             md5(coalesce(doc_id::varchar, '')) as hash
      from documents),
    own as (select source, sum(size)::bigint as source_size from docs group by source),
    ranked as (
      select *, (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} as phase from own),
    weighed as (
      select *, [{weights}][phase + 1] as weight, source_size * {mixing.CAP} as cap, coalesce('=' || source, '') as key from ranked),
    running as (
      select *, cap / weight as ratio, sum(source_size) over () as total, sum(weight) over () as weights,
             coalesce(sum(cap) over w, 0) as full_, coalesce(sum(weight) over w, 0) as gone
      from weighed
      window w as (order by cap / weight, key rows between unbounded preceding and 1 preceding)),
    lifted as (select *, (total - full_)::double / (weights - gone) as lift from running),
    common as (select ratio as r0, key as k0, lift as l0 from lifted where ratio >= lift order by ratio, key limit 1),
    goals as (
      select source, source_size, phase,
             case when r0 is not null and (ratio > r0 or (ratio = r0 and key >= k0)) then least(weight * l0, cap::double) else cap::double end as target
      from lifted left join common on true),
    placed as (
      select doc_id, size, source_size, phase, target,
             coalesce(sum(size) over (partition by d.source order by hash, doc_id, size rows between unbounded preceding and 1 preceding), 0)
               + size / 2.0::double as middle
      from docs d join goals g on d.source is not distinct from g.source),
    taken as (
      select *, (case when middle <= target then 1 else 0 end) + (case when middle + source_size <= target then 1 else 0 end)
               + (case when middle + source_size * 2 <= target then 1 else 0 end) as copies,
             case when target > 0 then middle / target else 0.0::double end as share
      from placed)
    select doc_id, size, source_size, target, size * copies as taken,
           case when copies > 0 then {_positions()} end as position
    from taken"""


def _multi_index() -> str:
    return f"""
    with recursive v as (
      select vec_id, embedding::double[] as e,
             embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
               and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fine
      from embeddings),
    links as (
      select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id
      where a.fine and b.fine and list_cosine_similarity(a.e, b.e) >= {multi_index.COSINE}),
    reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
    n as (select u, count(*) as n_links from links group by u),
    low as (select u, min(v) as low from reach group by u)
    select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
           vec_id = least(vec_id, coalesce(low, vec_id)) as kept
    from v left join n on vec_id = n.u left join low on vec_id = low.u"""


def _quoted(of) -> str:
    return ", ".join("'" + w + "'" for w in of)


def _quality_rules() -> str:
    classes = ", ".join("len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))" for p in rules.CLASSES.values())
    common = ", ".join(f"len(list_filter(w, lambda x: x = '{x}'))" for x in rules.VOCABULARY)
    n_classes, n_words, size = len(rules.CLASSES) + 2, len(rules.VOCABULARY) + 1, rules.WINDOW

    def sums(column: str, n: int) -> str:
        return "[" + ", ".join(f"sum({column}[{k + 1}])" for k in range(n)) + "]"

    def far(column: str) -> str:
        share = f"list_transform({column}, lambda x: x / list_sum({column}))"
        term = "(case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end) + (case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end)"
        zipped = f"list_transform(list_zip({share}, r_{column}), lambda z: {term})"
        return f"case when list_sum({column}) > 0 then list_sum({zipped}) / 2 else 0 end"

    return f"""
    with cut as (
      select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
    windows as (
      select rid, i, array_to_string(w[i:i + {size - 1}], ' ') as k
      from (select rid, w, unnest(range(1, len(w) - {size - 2})) as i from cut where len(w) >= {size})),
    twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from windows) where n > 1),
    covered as (
      select rid, sum(least({size}, coalesce(nxt - i, {size}))) as n
      from (select rid, i, lead(i) over (partition by rid order by i) as nxt from twice) group by rid),
    lines as (
      select rid, count(*) - count(distinct line) as n
      from (select rid, unnest(string_split(t, chr(10))) as line from cut) where regexp_matches(line, '{_WORD}') group by rid),
    measured as (
      select c.rid, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines,
             coalesce(v.n, 0)::bigint as n_repeat_words, [{classes}] as c0, [{common}] as m0, length(t) as chars
      from cut c left join covered v on c.rid = v.rid left join lines l on c.rid = l.rid),
    histograms as (
      select *, list_transform(c0 || [chars - word_chars, word_chars - list_sum(c0)], lambda x: x::double) as classes,
             list_transform(m0 || [n_words - list_sum(m0)], lambda x: x::double) as common from measured),
    summed as (
      select lang, {sums("classes", n_classes)} as s1, {sums("common", n_words)} as s2
      from histograms where lang in ({_quoted(rules.COMMON_WORDS)}) group by lang),
    refs as (
      select list_transform(s1, lambda x: x / list_sum(s1)) as r_classes, list_transform(s2, lambda x: x / list_sum(s2)) as r_common
      from summed where list_sum(s2) > 0),
    divergences as (
      select rid, min({far("classes")}) as d1, min({far("common")}) as d2 from histograms, refs group by rid),
    judged as (
      select h.*, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEATED_PCT} * n_words as base_failed,
             coalesce(d1, 0) as d1, coalesce(d2, 0) as d2
      from histograms h left join divergences d on h.rid = d.rid)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not ((word_chars >= {rules.MIN_CHARS} and d1 > {rules.MAX_CLASS_DIVERGENCE})
             or (n_words >= {rules.MIN_COMMON} and d2 > {rules.MAX_WORD_DIVERGENCE})) as kept
    from judged"""


def _manifest() -> str:
    told = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({' || '.join(told(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    # crc32 of the decimal id, a bit at a time
    bits = "xor(r >> 1, 3988292384 * (r & 1))"
    crc = f"list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, o: {bits}))"
    parents = "list_transform(generate_series(1, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k - 1] || coalesce(nodes[2 * k], '')))"
    step = lambda at: f"case when {at} % 2 = 1 then 'L' || nodes[{at}] when {at} + 2 <= len(nodes) then 'R' || nodes[{at} + 2] else 'N' end"
    return f"""
    with recursive leaves as (
      select *, {leaf('n_chars')} as leaf, {leaf('(n_chars + 1)')} as changed,
             xor(({crc}), 4294967295::ubigint) % 7 = 0 as wrong, coalesce('=' || lang, '') as grp
      from documents),
    placed as (
      select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from leaves),
    trees as (
      select grp, 0 as level, list(leaf order by pos) as nodes from placed group by grp
      union all
      select grp, level + 1, {parents} from trees where len(nodes) > 1),
    subroots as (
      select grp, nodes[1] as subroot, level as depth, row_number() over (order by grp) - 1 as place from trees where len(nodes) = 1),
    crown as (
      select 0 as level, list(subroot order by place) as nodes from subroots
      union all
      select level + 1, {parents} from crown where len(nodes) > 1),
    steps as (
      select doc_id, pos, p.grp, level, {step('(pos >> level)')} as step
      from placed p join trees t on p.grp = t.grp where len(nodes) > 1
      union all
      select doc_id, pos, p.grp, depth + level, {step('(place >> level)')}
      from placed p join subroots s on p.grp = s.grp, crown where len(nodes) > 1),
    ways as (select grp, pos, list(step order by level) as way from steps group by grp, pos),
    told as (
      select doc_id, leaf, subroot, (select nodes[1] from crown where len(nodes) = 1) as root, coalesce(way, []) as way,
             case when wrong then coalesce(changed, leaf) else leaf end as shown
      from placed p join subroots s on p.grp = s.grp left join ways w on p.grp = w.grp and p.pos = w.pos)
    select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from (
      select *, sha256(array_to_string(list_transform(list_filter(way, lambda s: s <> 'N'), lambda s: s[2:]), '')) as proof_sha256,
             list_reduce(list_prepend(shown, way), lambda a, s: sha256(
               case when s[1] = 'L' then s[2:] || a when s[1] = 'R' then a || s[2:] else a end)) as folded_root
      from told)
    """


def all_sql() -> dict[str, str]:
    return {"op1_mixing": _mixing(), "op5_quality_rules": _quality_rules(), "op9_multi_index": _multi_index(), "op12_merkle_manifest": _manifest()}
