"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substring_dedup() -> str:
    return f"""
    with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
    starts as (select r, doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50),
    windows as (select r, doc_id, s, array_to_string(w[s : s + 49], ' ') as words from starts),
    firsts as (select words, min(doc_id) as low from windows group by words),
    late as (select r, s from windows join firsts on windows.words = firsts.words where doc_id > low),
    covered as (select distinct r, place from (select r, unnest(range(s, s + 50)) as place from late) x),
    places as (select r, unnest(w) as word, generate_subscripts(w, 1) as place from d),
    lines as (
        select p.r, count(c.place) as n_removed,
            string_agg(case when c.place is null then word end, ' ' order by p.place) as line
        from places p left join covered c on c.r = p.r and c.place = p.place group by p.r
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
        sha256(coalesce(line, '')) as kept_sha256
    from d left join lines on d.r = lines.r
    """


def source_mixing() -> str:
    """Every subset of the units held back is summed and compared. The capped sources are those before the first one that its share does not exceed, by cap over weight."""
    return f"""
    with recursive d as (
        select doc_id, source, len({WORDS})::bigint as size,
            md5('mix-1|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))) as h
        from documents
    ),
    sources as (
        select source, sum(size)::bigint as source_size,
            ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
        from d group by source
    ),
    total as (select sum(source_size)::double as total from sources),
    filled(round, rest, weights) as (
        select 0, total, (select sum(weight)::double from sources) from total
        union all
        select round + 1,
            total - coalesce((select sum(3 * source_size) from sources where 3.0::double * source_size < f.rest * weight / f.weights), 0),
            (select sum(weight)::double from sources where not (3.0::double * source_size < f.rest * weight / f.weights))
        from filled f, total where round < 40
    ),
    level as (select rest, weights from filled order by round desc limit 1),
    targets as (
        select source, source_size,
            case when 3.0::double * source_size < rest * weight / weights then 3.0::double * source_size else rest * weight / weights end as target
        from sources, level
    ),
    plan as (
        select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as whole from targets
    ),
    wanted as (select *, target - whole * source_size as want from plan),
    units as (select source, h, sum(size)::bigint as size from d group by source, h),
    by_size as (select *, row_number() over (partition by source order by size desc, h) as k from units),
    by_hash as (select *, row_number() over (partition by source order by h) as j from by_size where k > 12),
    held as (
        select source, h, size, k - 1 as bit from by_size where k <= 12
        union all select source, h, size, j + 11 from by_hash where j <= 6
    ),
    held_sums as (
        select source, sum(size) filter (where bit < 6)::bigint as top, coalesce(sum(size) filter (where bit >= 6), 0)::bigint as fine,
            sum(size)::bigint as total from held group by source
    ),
    masks as (select range::bigint as mask from range(512)),
    tops as (
        select source, mask, coalesce(sum(size) filter (where (mask >> bit) & 1 = 1), 0)::bigint as picked
        from held join masks on mask < 64 where bit < 6 group by source, mask
    ),
    settled as (
        select w.source, arg_min(picked, (
            greatest(greatest(picked - want, (want - picked) - (source_size - top)), 0.0),
            case when source_size > 0 then abs(picked - want / source_size * top) else picked end, mask)) as picked
        from wanted w join tops t on t.source is not distinct from w.source
            join held_sums s on s.source is not distinct from w.source group by w.source
    ),
    goals as (
        select w.source, least(greatest(want - picked - fine / 2.0::double, 0.0), (source_size - total)::double) as goal
        from wanted w join settled t on t.source is not distinct from w.source
            join held_sums s on s.source is not distinct from w.source
    ),
    others as (
        select u.source, u.h, sum(u.size) over (partition by u.source order by u.h) as upto
        from by_size u left join by_hash f on f.source is not distinct from u.source and f.h = u.h where u.k > 12 and f.j > 6
    ),
    cut as (
        select g.source, coalesce(max(case when upto <= goal then h end), '') as cut_hash,
            coalesce(max(case when upto <= goal then upto end), 0) as reached
        from goals g left join others o on o.source is not distinct from g.source group by g.source
    ),
    low as (
        select source, mask, coalesce(sum(size) filter (where bit < 9 and (mask >> bit) & 1 = 1), 0)::bigint as picked
        from held, masks group by source, mask
    ),
    high as (
        select source, mask * 512 as mask, coalesce(sum(size) filter (where bit >= 9 and (mask >> (bit - 9)) & 1 = 1), 0)::bigint as picked
        from held, masks group by source, mask
    ),
    best as (
        select w.source, arg_min(l.mask + u.mask, (abs((want - reached) - (l.picked + u.picked)), l.mask + u.mask)) as mask
        from wanted w join cut c on c.source is not distinct from w.source
            join low l on l.source is not distinct from w.source join high u on u.source is not distinct from w.source
        group by w.source
    )
    select doc_id, d.size, source_size, target,
        (d.size * (whole + case when x.bit is not null then (mask >> x.bit) & 1 when d.h <= cut_hash then 1 else 0 end))::bigint as taken
    from d join wanted w on d.source is not distinct from w.source
        join cut c on d.source is not distinct from c.source join best b on d.source is not distinct from b.source
        left join held x on d.source is not distinct from x.source and d.h = x.h
    """


def line_dedup() -> str:
    return r"""
    with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
    places as (select r, unnest(parts) as line, generate_subscripts(parts, 1) as place from d),
    keyed as (
        select r, place, line,
            translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from places
    ),
    common as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10),
    cut as (
        select k.r, count(*) filter (where c.key is not null) as n_dropped,
            string_agg(case when c.key is null then line end, chr(10) order by place) as line
        from keyed k left join common c on k.key = c.key group by k.r
    )
    select doc_id, len(parts)::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(coalesce(line, '')) as kept_sha256
    from d join cut on d.r = cut.r
    """


def filter_audit() -> str:
    letters = "('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)"
    return f"""
    with split as (
        select coalesce(source, '') as part, doc_id, coalesce(text, '') as body, {WORDS} as w from documents
    ),
    failed as (
        select part, doc_id,
            (case when len(w) < 50 then 1 else 0 end)
            + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
            + (case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) then 4 else 0 end)
            + (case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end)
            + (case when doc_id > min(doc_id) over (partition by body) then 16 else 0 end) as mask
        from split
    ),
    judged as (
        select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
        from labels group by doc_id
    ),
    cells as (
        select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
        from failed left join judged on failed.doc_id = judged.doc_id group by part, mask
    ),
    letter(f, b) as (values {letters}),
    orders as (
        select v.f || w.f || x.f || y.f || z.f as filter_order, [v.b, w.b, x.b, y.b, z.b] as bits
        from letter v, letter w, letter x, letter y, letter z where v.b | w.b | x.b | y.b | z.b = 31
    ),
    steps as (
        select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1 : step - 1]), 0)::int as earlier
        from orders, range(1, 6) t(step)
    ),
    counted as (
        select part, filter_order, step, bit,
            sum(case when mask & (earlier | bit) = 0 then n else 0 end) as kept,
            sum(case when mask & earlier = 0 and mask & bit > 0 then n else 0 end) as removed,
            sum(case when mask & earlier > 0 and mask & bit > 0 then n else 0 end) as redundant,
            sum(case when mask = bit then n else 0 end) as unique_fails,
            sum(case when mask & earlier = 0 and mask & bit > 0 then good else 0 end) as good_lost,
            sum(case when mask & earlier = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
        from cells, steps group by part, filter_order, step, bit
    )
    select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
        redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
        toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
    from counted
    """


def merkle_manifest() -> str:
    """Checksums are CRC-32 bit by bit over the digits of an id."""
    def field(name: str) -> str:
        return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"

    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    return f"""
    with recursive d as (
        select row_number() over () as r, doc_id, coalesce('=' || source, '') as tree,
            sha256({head} || {field('text')}) as leaf,
            sha256({head} || {field("replace(text, chr(10), '')")}) as cut_leaf,
            list_reduce(
                [4294967295::bigint] || flatten([[-1 - ascii(c)::bigint, -2, -2, -2, -2, -2, -2, -2, -2]
                    for c in string_split(doc_id::varchar, '')]),
                lambda a, x: case when x = -2 then case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end
                    else xor(a, -1 - x) end
            ) as crc
        from documents
    ),
    leaves as (
        select *, row_number() over (partition by tree order by doc_id nulls first, leaf, cut_leaf) - 1 as place,
            count(*) over (partition by tree) as n,
            case when xor(crc, 4294967295::bigint) % 2 = 0 then cut_leaf else leaf end as checked
        from d
    ),
    nodes(tree, level, place, n, h) as (
        select tree, 0, place, n, leaf from leaves
        union all
        select tree, max(level) + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by place))
        from nodes where n > 1 group by tree, place // 3
    ),
    subroots as (
        select tree, level as height, h as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n
        from nodes where n = 1
    ),
    crown(level, place, n, h) as (
        select 0, place, n, subroot from subroots
        union all
        select max(level) + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by place))
        from crown where n > 1 group by place // 3
    ),
    ways as (
        select l.r, x.level, x.place as other, (l.place // (3 ** x.level)::bigint) as own, x.h
        from leaves l join nodes x on x.tree = l.tree and x.n > 1
            and x.place // 3 = l.place // (3 ** (x.level + 1))::bigint
        union all
        select l.r, s.height + x.level, x.place, (s.place // (3 ** x.level)::bigint), x.h
        from leaves l join subroots s on s.tree = l.tree join crown x on x.n > 1
            and x.place // 3 = s.place // (3 ** (x.level + 1))::bigint
    ),
    steps as (
        select r, level, coalesce(string_agg(h, '' order by other) filter (where other < own), '') as low,
            coalesce(string_agg(h, '' order by other) filter (where other > own), '') as high
        from ways group by r, level
    ),
    proofs as (select r, sha256(string_agg(low || high, '' order by level)) as proof_sha256 from steps group by r),
    folds(r, level, h) as (
        select r, 0, checked from leaves
        union all
        select f.r, f.level + 1, sha256(low || f.h || high) from folds f join steps s on s.r = f.r and s.level = f.level
    ),
    folded as (select r, arg_max(h, level) as folded_root from folds group by r)
    select l.doc_id, l.leaf, s.subroot, c.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.folded_root,
        f.folded_root = c.h as verified
    from leaves l join subroots s on s.tree = l.tree join (select h from crown where n = 1) c on true
        join folded f on f.r = l.r left join proofs p on p.r = l.r
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op8_substring_dedup": substring_dedup(),
        "op9_source_mixing": source_mixing(),
        "op11_line_dedup": line_dedup(),
        "op12_filter_audit": filter_audit(),
        "op13_merkle_manifest": merkle_manifest(),
    }
