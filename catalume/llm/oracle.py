"""DuckDB SQL of the queries that SQL can express.

op6 (a tree of a page), op7 (longest matches), op8 (its trained tree), op10 (a trained network)
and op11 (a tokenizer's ids) have none; tests hold them against plain versions.
"""

from __future__ import annotations

import re

from catalume.llm import quality as Q

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{UP}', '{LOW}')"

OP1 = f"""with recursive w as (select doc_id, {WORDS.format(LOWER)} as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
link as (select a, b from e union all select b, a from e),
walk(node, top) as (select doc_id, doc_id from documents union select l.b, w.top from walk w join link l on l.a = w.node where w.top < l.b),
comp as (select node, min(top) as top from walk group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, top as component_id, top = d.doc_id as kept from documents d join comp on node = d.doc_id left join n on n.doc_id = d.doc_id"""

OP2 = """with l as (select conv_id, arg_max(struct_pack(turn := turn, text := text), struct_pack(turn := turn, text := text)) as own from conversations where role = 'assistant' group by 1),
o as (select *, row_number() over (order by md5(coalesce(conv_id::varchar, '')), conv_id nulls first) - 1 as rank from l),
p as (select a.conv_id, a.own, b.own as other from o a left join o b on b.rank = xor(a.rank, 1)),
s as (select c.conv_id, turn, role, text, p.own is not null and coalesce(role = 'assistant' and turn is not distinct from own.turn and text is not distinct from own.text, false) as swap, other from conversations c left join p on p.conv_id is not distinct from c.conv_id),
t as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.k, b.k) as k, a.role, a.text as x, b.role as role_y, b.text as y, a.k as kx, b.k as ky
    from (select *, row_number() over (partition by conv_id order by turn, role, text) as k from s) a
    full join (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as k from (select conv_id, turn, role, case when swap then other.text else text end as text from s where not (swap and other is null))) b on a.conv_id is not distinct from b.conv_id and a.k = b.k),
m as (select conv_id, least(coalesce(min(k) filter (where kx is not null and ky is not null and (x is distinct from y or role is distinct from role_y)) - 1, max(k)), count(kx), count(ky)) as n from t group by 1),
r as (select t.*, n, case when kx is not null then '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(x, '') || chr(10) end as rx, case when ky is not null then '<|' || coalesce(role_y, '') || '|>' || chr(10) || coalesce(y, '') || chr(10) end as ry from t join m on m.conv_id is not distinct from t.conv_id),
z as (select *, sum(length(rx)) over w as ex, sum(length(ry)) over w as ey from r where k > n window w as (partition by conv_id order by k rows unbounded preceding)),
q as (select conv_id, string_agg(rx, '' order by k) as chosen, string_agg(ry, '' order by k) as rejected,
    string_agg((ex - length(coalesce(x, '')) - 1)::bigint || '-' || ex::bigint, ',' order by k) filter (where role = 'assistant') as chosen_mask,
    string_agg((ey - length(coalesce(y, '')) - 1)::bigint || '-' || ey::bigint, ',' order by k) filter (where role_y = 'assistant') as rejected_mask from z group by 1),
h as (select conv_id, string_agg(rx, '' order by k) as prompt from r where k <= n group by 1)
select m.conv_id, n::int as n_common, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected, coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from m left join q on q.conv_id is not distinct from m.conv_id left join h on h.conv_id is not distinct from m.conv_id"""

OP3 = f"""with d as (select doc_id, source, len({WORDS.format("coalesce(text, '')")})::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by 1),
s1 as (select *, row_number() over (order by source nulls last) - 1 as k, source_size * 2.0::double as cap from s0),
s2 as (select *, (case k % 3 when 0 then 3 when 1 then 1 else 2 end)::double as weight from s1),
s3 as (select *, coalesce(sum(cap) over before, 0::double) as filled, coalesce(sum(weight) over before, 0::double) as taken_w, sum(source_size) over () * 1.5::double as every, sum(weight) over () as w
    from s2 window before as (order by cap / weight, k rows between unbounded preceding and 1 preceding)),
s4 as (select *, case when (every - filled) / (w - taken_w) * weight <= cap then (every - filled) / (w - taken_w) end as level from s3),
s5 as (select *, first_value(level ignore nulls) over (order by cap / weight, k rows between unbounded preceding and current row) as lv from s4),
t as (select source, source_size, least(cap, coalesce(lv * weight, cap)) as target, case when source_size > 0 then least(cap, coalesce(lv * weight, cap)) / source_size else 0 end as rate,
    ('0x' || substr(md5('11:' || coalesce(source, '')), 1, 5))::bigint / 1048576::double as u from s5),
r as (select d.*, t.source_size, t.target, t.rate, t.u, row_number() over (partition by d.source order by length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::bigint) & 7), md5(coalesce(doc_id::varchar, 'null')), doc_id, size) - 1 as k
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(u + (k + 1) * rate) - floor(u + k * rate)) * size)::bigint as taken from r"""

#: crc32 of a BLOB, by a table of bytes (needs the table tab).
CRC_TABLE = "tab as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({0}), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"

OP4 = """with recursive tab as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
d as (select doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::bigint as size,
    case when text is not null then xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) end as text_crc32 from documents, tab),
jump(doc_id, n, b, j, key) as (select distinct doc_id, n, -1::bigint, 0::bigint, doc_id::hugeint from d, (values (8), (9)) v(n)
    union all select doc_id, n, j, floor((j + 1) * (2147483648::double / ((key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint // 8589934592 + 1)::double))::bigint,
        (key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint from jump where j < n),
s as (select doc_id, max(b) filter (where n = 8) as shard, max(b) filter (where n = 9) as grown from jump where j >= n group by 1)
select d.doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by (coalesce(d.doc_id % 1000003 * 31, 0) + coalesce(text_crc32, 0)) % 4096, d.doc_id, text_crc32, size) - 1 as slot, grown::int as grown_shard
from d join s on s.doc_id = d.doc_id"""

ITEM = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(UP, LOW)
OP5 = f"""with i as (select item_id, {ITEM} as w from benchmark), d as (select doc_id, {ITEM} as w from documents),
iw as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as g from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from i where len(w) > 0)),
dw as (select doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iw))),
m as (select dw.doc_id, dw.p, dw.k, iw.item_id from dw join iw on iw.k = dw.k and iw.g = dw.g),
h as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(p, p + k)) as pos from m) group by 1),
f as (select doc_id, count(*) as n, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) as s from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0) as n_hit, coalesce(f.n, 0) as n_items, coalesce(f.s, sha256('')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join h on h.doc_id = d.doc_id left join f on f.doc_id = d.doc_id"""


def _op9() -> str:
    """The concentration steps as one common table after the other."""
    x, p = [f"x_{i}" for i in range(Q.P)], range(Q.P)
    double = lambda sql: re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?|1e-\d+)", r"\1::double", sql)
    unit = [f"round({Q.UNIT} * ({s}))::bigint as x_{i}" for i, s in enumerate(Q.STATISTICS)]
    middle = lambda c: f"min({c}) filter (where 2 * upto_{c} >= every)"
    moments = [(f"a_{i}", f"n * x_{i}") for i in p] + [(f"b_{i}{j}", f"n * x_{i} * x_{j}") for i, j in Q.PAIRS]

    def chain(name: str, source: str, columns: list[tuple[str, str]], keep: str) -> str:
        out = source
        for k, (c, sql) in enumerate(columns):
            out = f"(select *, {double(sql)} as {c} from {out} as q{k})"
        keep, _, only = keep.partition(" qualify ")
        return f"{name} as (select {keep} from {out}{' qualify ' + only if only else ''})"

    def medians(name: str, source: str, sql: list[str], out: str) -> str:
        """Lower medians by counts."""
        upto = ", ".join(f"sum(n) over (partition by gid order by {c} range unbounded preceding) as upto_{c}" for c in x)
        return f"{name} as (select gid, any_value(every) as every, {', '.join(f'{middle(c)} as {out}_{i}' for i, c in enumerate(x))} from (select *, {upto}, sum(n) over (partition by gid) as every from (select gid, {', '.join(f'{q} as {c}' for q, c in zip(sql, x, strict=True))}, n from {source})) group by 1)"

    keep = f"gid, start, {', '.join(f'm_{i}' for i in p)}, {', '.join(f'l_{i}{j}' for i, j in Q.PAIRS)}"
    zero = ", ".join(f"0::double as m_{i}" for i in p)
    mean = lambda t, i, j: f"round(sum(n * {t}_{i} * {t}_{j}) / sum(n), 6) as {t}{i}{j}"
    entry = [lambda i, j: f"d_{i} * d_{j} * {int(i == j)}", lambda i, j: f"d_{i} * d_{j} * t{i}{j}", lambda i, j: f"d_{i} * d_{j} * u{i}{j} * {Q.P}"]
    starts = " union all ".join(f"select gid, {k} as start, {zero}, {', '.join(f'{e(i, j)} as s_{i}{j}' for i, j in Q.PAIRS)} from st" for k, e in enumerate(entry))
    parts = [
        f"w as (select doc_id, lang, source, {WORDS.format("coalesce(text, '')")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) as l, coalesce(text, '') as t from documents)",
        "g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2))",
        "r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as k from g) where k > 1) group by 1)",
        f"b as (select w.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '{Q.SYMBOLS}'))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from w left join r on r.doc_id = w.doc_id)",
        "f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce('=' || lang, '-') as g1, coalesce('=' || lang, '-') || chr(1) || coalesce('=' || source, '-') as g0 from b)",
        f"u as (select doc_id, g0, g1, '' as g2, {', '.join(unit)} from f where not base_failed)",
        f"pts as (select gid, {', '.join(x)}, count(*) as n from (select g0 as gid, {', '.join(x)} from u union all select g1, {', '.join(x)} from u union all select g2, {', '.join(x)} from u) group by all)",
        medians("med", "pts", x, "c"),
        f"near as (select gid, {', '.join(f'greatest(-{Q.FAR}, least({Q.FAR}, x_{i} - c_{i})) as x_{i}' for i in p)}, n from pts join med using (gid))",
        medians("mad", "near", [f"abs({c})" for c in x], "a"),
        f"sd as (select gid, {', '.join(f'{double(e)} as d_{i}' for i, e in enumerate(Q.SCALE))} from mad)",
        f"st as (select gid, {', '.join(f'd_{i}' for i in p)}, {', '.join(mean(t, i, j) for t in 'tu' for i, j in Q.PAIRS)} from (select gid, n, {', '.join(f'd_{i}' for i in p)}, {', '.join(f'{double(e)} as t_{i}' for i, e in enumerate(Q.BOUNDED))}, {', '.join(f'{double(e)} as u_{i}' for i, e in enumerate(Q.DIRECTION))} from near join sd using (gid)) group by gid, {', '.join(f'd_{i}' for i in p)})",
        "kinds as (select gid, count(*) as kinds from near group by 1)",
        f"dr as (select gid, start, {', '.join(f'avg(x_{i}) as m_{i}' for i in p)}, {', '.join(f'avg(x_{i} * x_{j}) as b_{i}{j}' for i, j in Q.PAIRS)} from near join kinds using (gid), range(3, {3 + Q.DRAWS}) t(start) where ('0x' || substr(md5(concat_ws(',', start, {', '.join(x)})), 1, 8))::bigint * kinds < {Q.DRAWN << 32} group by 1, 2)",
        chain("p0", f"({starts} union all select gid, start, {', '.join(f'm_{i}' for i in p)}, {', '.join(f'b_{i}{j} - m_{i} * m_{j}' for i, j in Q.PAIRS)} from dr)", Q.cholesky(), keep),
    ]
    spread = " + ".join(f"ln(l_{i}{i})" for i in p)
    for k in range(Q.STEPS):
        again = ", ".join(f"(coalesce(sum({c}) filter (where share is null), 0)::double + coalesce(max(share * {c}), 0)) / h as {c}" for c, _ in moments)
        s = ", ".join(f"{Q.CONSISTENT!r}::double * (b_{i}{j} - a_{i} * a_{j}) as s_{i}{j}" for i, j in Q.PAIRS)
        parts += [
            chain(f"d{k}", f"(select * from near join p{k} using (gid))", Q.forward(), f"gid, start, {', '.join(x)}, n, floor(ln({Q.DISTANCE} + 1e-6) * {Q.BINS})::int as bin"),
            f"e{k} as (select *, coalesce(sum(n) over (partition by gid, start order by bin rows between unbounded preceding and 1 preceding), 0) as before, {Q.SUPPORT}::double * sum(n) over (partition by gid, start) as h from (select gid, start, bin, sum(n) as n, {', '.join(f'sum({e}) as {c}' for c, e in moments)} from d{k} group by 1, 2, 3))",
            f"h{k} as (select gid, start, h, {again} from (select *, case when before + n > h then (h - before) / n end as share from e{k} where before < h) group by 1, 2, 3)",
            chain(f"p{k + 1}", f"(select gid, start, {', '.join(f'a_{i} as m_{i}' for i in p)}, {s} from h{k})", Q.cholesky(), keep + (f" qualify row_number() over (partition by gid order by {spread}, start) <= {Q.BEST}" if k == 1 else "")),
        ]
    # a group leans on its language, that on all documents, these on a wide scatter
    square = lambda i, j: " + ".join(f"l_{i}{c} * l_{j}{c}" for c in range(j + 1))
    wide = [(3 * sd * Q.UNIT) ** 2 for sd in (0.06, 0.10, 0.20, 0.14)]
    part = lambda k: f"(select gid, every::double / (every::double + 20) as w, {', '.join(f'c_{i} + m_{i} as m_{i}' for i in p)}, {', '.join(f'{square(i, j)} as s_{i}{j}' for i, j in Q.PAIRS)} from good)"
    lean = lambda c, last: f"a.w * a.{c} + (1 - a.w) * (b.w * b.{c} + (1 - b.w) * {last}) as {c}"
    rest = lambda i, j: f"(e.w * e.s_{i}{j} + (1 - e.w) * {wide[i] if i == j else 0.0}::double)"
    both = f"select f.g0, {', '.join(lean(f'm_{i}', f'e.m_{i}') for i in p)}, {', '.join(lean(f's_{i}{j}', rest(i, j)) for i, j in Q.PAIRS)} from (select distinct g0, g1 from u) f join {part(0)} a on a.gid = f.g0 join {part(1)} b on b.gid = f.g1 join {part(2)} e on e.gid = ''"
    parts += [
        f"best as (select * from p{Q.STEPS} qualify row_number() over (partition by gid order by {spread}, start) = 1)",
        "good as (select * from best join med using (gid))",
        chain("judges", f"({both})", Q.cholesky(), f"g0, {', '.join(f'm_{i}' for i in p)}, {', '.join(f'l_{i}{j}' for i, j in Q.PAIRS)}"),
        chain("v", "(select * from u join judges using (g0))", Q.forward(), f"doc_id, {Q.DISTANCE} as distance2"),
    ]
    return f"with {', '.join(parts)} select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(distance2, 6) as distance2, not base_failed and not coalesce(distance2 > {Q.chi2_quantile(Q.WITHIN)!r}::double, false) as kept from f left join v on v.doc_id = f.doc_id"


def _merkle(levels: int = 13, levels_of_sources: int = 6) -> str:
    """Level by level: nodes (t), runs of three (r), and for each row its place, folded digest and siblings so far (w). Enough for 3 ** levels rows of a source."""
    part = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = CRC.format("encode(coalesce(doc_id::varchar, ''))")
    steps = [
        f"""with recursive {CRC_TABLE}, d as (select row_number() over () as row, doc_id, source, {leaf("text")} as leaf, case when {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as seen,
            dense_rank() over (order by source nulls first) - 1 as g from documents, tab)""",
        "w0 as (select row, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, seen as own, '' as proof from d)",
        "t0 as (select w0.g, i, count(*) over (partition by w0.g) as n, leaf as h from w0 join d using (row))",
    ]

    def climb(a: int, b: int) -> None:
        for k in range(a, b):
            steps.extend([
                f"r{k} as (select g, i, any_value(n) as n, list(h order by p) as hs from (select g, i as p, i // 3 as i, n, h from t{k}) group by g, i)",
                f"t{k + 1} as (select g, i, (n + 2) // 3 as n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from r{k})",
                f"""w{k + 1} as (select w.row, w.g, r.i, case when n = 1 then own else sha256(array_to_string(hs[:w.i % 3], '') || own || array_to_string(hs[w.i % 3 + 2:], '')) end as own,
                    case when n = 1 then proof else proof || array_to_string(hs[:w.i % 3], '') || array_to_string(hs[w.i % 3 + 2:], '') end as proof from w{k} w join r{k} r on r.g = w.g and r.i = w.i // 3)""",
            ])

    climb(0, levels)
    steps.append(f"t{levels + 1} as (select 0 as g, g as i, count(*) over () as n, h from t{levels})")
    steps.append(f"w{levels + 1} as (select row, 0 as g, g as i, own, proof from w{levels})")
    climb(levels + 1, levels + 1 + levels_of_sources)
    last = levels + 1 + levels_of_sources
    return ", ".join(steps) + f""" select doc_id, leaf, s.h as subroot, z.h as root, sha256(proof) as proof_sha256, own as folded_root, own = z.h as verified, source
        from d join w{last} w using (row) join t{levels} s on s.g = d.g cross join t{last} z"""


#: Every pair of equal words of a text gives a period; neighbouring pairs of one period make a run.
OP12 = f"""with recursive {CRC_TABLE}, b as (select row_number() over () as row, doc_id, {WORDS.format("coalesce(text, '')")} as w, {CRC.format("encode(coalesce(doc_id::varchar, ''))")} as h from documents, tab),
c as (select *, len(w) as n, h // 10 as g, (h // 10) % greatest(len(w), 1) as a from b),
d as (select *, 1 + (n - a) // (3 + g % 8) as p from c),
t as (select row, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end as w from d),
x as (select row, unnest(range(len(w))) as i, unnest(w) as word from t),
e as (select l.row, l.i, r.i - l.i as q from x l join x r on l.row = r.row and l.word = r.word and l.i < r.i),
s as (select row, q, min(i) as start, count(*) as k from (select *, i - row_number() over (partition by row, q order by i) as part from e) group by row, q, part),
r as (select row, start, k + q as length, min(q) as period from s where k >= q and k + q >= 12 group by row, start, k + q),
f as (select row, count(*) as n_runs, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by row),
k as (select row, string_agg(word, ' ' order by i) as kept from x where not exists (select 1 from r where r.row = x.row and x.i >= r.start + r.period and x.i < r.start + r.length) group by row)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from t left join f using (row) left join k using (row)"""


SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1,
    "op2_chat_preferences": OP2,
    "op3_mix_sources": OP3,
    "op4_jump_sharding": OP4,
    "op5_decontaminate": OP5,
    "op9_quality_rules": _op9(),
    "op12_periodic_runs": OP12,
    "op13_merkle_manifest": _merkle(),
}
