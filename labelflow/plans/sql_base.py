"""DuckDB SQL for the shared derived views (the oracle side of plans/fixtures.py).

``with_(names)`` returns a WITH clause holding the named views and everything they depend on."""

from __future__ import annotations

from labelflow.constants import WINDOW as L

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"""select doc_id, lang as label,
        translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', '------') as s from documents"""),
    "win": (("docs",), f"""select doc_id, label, s, unnest(range(0, cast(ceil(length(s) / {L}.0) as bigint))) as k
        from docs where length(s) > 0"""),
    "seqs": (("win",), f"""select cast(w.doc_id as varchar) || '_' || cast(w.k as varchar) as header,
        replace(rpad(substr(w.s, cast(w.k * {L} + 1 as bigint), {L}), {L}, '-'), '-', '') as sequence,
        rpad(substr(w.s, cast(w.k * {L} + 1 as bigint), {L}), {L}, '-') as sequence_align,
        w.label, (l.doc_id is not null) as is_train, w.doc_id, cast(w.k as integer) as k
        from win w left join (select distinct doc_id from labels) l on w.doc_id = l.doc_id"""),
    "sites": (("seqs",), f"""select header, is_train, label, cast(r.i as integer) as pos,
        substr(sequence_align, cast(r.i as bigint), 1) as aa from seqs, range(1, {L + 1}) r(i)"""),
    "pk": (("sites",), f"""select s.header, s.is_train, s.label, s.pos, s.aa, p.method, p.m,
        case p.method when 'msa' then s.pos when 'contrastive' then cast(floor((s.pos - 1) / 8) as integer) else 0 end as bucket
        from sites s, (values ('msa', 1), ('contrastive', 8), ('foundation', {L})) p(method, m)"""),
    "prof": (("pk",), """select method, label, bucket, aa, m, count(*) as n from pk where is_train
        group by method, label, bucket, aa, m"""),
    "sizes": (("prof",), """select label, sum(n) as n_seq from prof where method = 'msa' and bucket = 1 group by label"""),
    "sc": (("prof",), """select q.header, q.method, f.label, sum(f.n) as hits from pk q
        join prof f on q.method = f.method and q.bucket = f.bucket and q.aa = f.aa
        where not q.is_train group by q.header, q.method, f.label"""),
    "preds": (("sc", "sizes", "seqs"), f"""select method, header, label, (s*s*s*s*s*s*s*s) / sum(s*s*s*s*s*s*s*s)
          over (partition by header, method) as p
        from (select h.method, h.header, z.label,
                     cast(coalesce(sc.hits, 0) as double) / cast(z.n_seq * h.m * {L} as double) as s
              from (select q.header, p.method, p.m from seqs q,
                    (values ('msa', 1), ('contrastive', 8), ('foundation', {L})) p(method, m) where not q.is_train) h
              cross join sizes z
              left join sc on sc.header = h.header and sc.method = h.method and sc.label = z.label) t"""),
    "best": (("preds",), """select method, header, label, p from (
        select *, row_number() over (partition by method, header order by round(p, 9) desc, label) as rn
        from preds) z where rn = 1"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for d in VIEWS[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        visit(n)
    return seen


def with_(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    parts = [f"{n} as ({VIEWS[n][1]})" for n in _order(names)]
    parts += [f"{n} as ({body})" for n, body in extra]
    return "with " + ",\n".join(parts) + "\n"

VIEWS.update({
    "scores": (("preds", "seqs"), """select p.method, p.header, s.label as label_true, p.label, p.p,
        round(p.p, 9) as score, cast(p.label = s.label as integer) as y
        from preds p join seqs s on p.header = s.header"""),
    "bestt": (("best", "seqs"), """select b.method, b.header, s.label as label_true, b.label, b.p
        from best b join seqs s on b.header = s.header"""),
    "tied": (("scores",), """select method, label, score, cast(sum(y) as bigint) as tp_d, cast(sum(1 - y) as bigint) as fp_d
        from scores group by method, label, score"""),
    "cum": (("tied",), """select *, cast(sum(tp_d) over w as bigint) as tp, cast(sum(fp_d) over w as bigint) as fp,
        cast(sum(tp_d) over (partition by method, label) as bigint) as P,
        cast(sum(fp_d) over (partition by method, label) as bigint) as N
        from tied window w as (partition by method, label order by score desc rows between unbounded preceding and current row)"""),
    "roc": (("cum",), """select method, label, score as threshold, tp, fp, fp / N as fpr, tp / P as tpr from cum
        union all select distinct method, label, null, 0, 0, 0.0, 0.0 from cum"""),
    "auc_c": (("cum",), """select method, label,
        case when sum(tp_d) > 0 and sum(fp_d) > 0 then sum(fp_d * (tp - tp_d / 2.0)) / (sum(tp_d) * sum(fp_d)) end as auc,
        cast(sum(tp_d) as bigint) as P, cast(sum(fp_d) as bigint) as N from cum group by method, label"""),
    "f1c": (("bestt",), """select method, label, sum(tp) as tp, sum(n_pred) as n_pred, sum(n_true) as n_true,
        2.0 * sum(tp) / (sum(n_pred) + sum(n_true)) as f1 from (
          select method, label, cast(label = label_true as integer) as tp, 1 as n_pred, 0 as n_true from bestt
          union all select method, label_true, 0, 0, 1 from bestt) z group by method, label"""),
    "f1m": (("f1c",), """select method, avg(f1) as f1_macro, sum(f1 * n_true) / sum(n_true) as f1_weighted,
        sum(tp) / sum(n_true) as accuracy from f1c group by method"""),
})

VIEWS.update({
    "conf": (("best", "seqs"), """select b.method, b.header, b.label, b.p as prob, s.label as label_true, s.sequence_align,
        (b.label = s.label) as is_correct from best b join seqs s on b.header = s.header where round(b.p, 9) >= 0.8"""),
    "trd": (("seqs",), """select sequence_align, header, row_number() over (order by header) as rk from
        (select sequence_align, min(header) as header from seqs where is_train group by sequence_align) z"""),
    "seqid": (("seqs", "trd"), """select sequence_align, n / length(sequence_align) as seq_id_train, header as nearest from (
        select sequence_align, best // 1000000000 as n, 1000000000 - best % 1000000000 as rk from (
          select q.sequence_align, max((length(q.sequence_align) - hamming(q.sequence_align, t.sequence_align)) * 1000000000 + 1000000000 - t.rk) as best
          from (select distinct sequence_align from seqs where not is_train) q, trd t group by q.sequence_align) y) x
        join (select rk, header from trd) d using (rk)"""),
    "confid": (("conf", "seqid"), """select c.*, i.seq_id_train from conf c join seqid i on c.sequence_align = i.sequence_align"""),
    "allid": (("best", "seqs", "seqid"), """select b.method, b.header, b.label, b.p as prob, s.label as label_true, (b.label = s.label) as is_correct,
        i.seq_id_train, i.nearest from best b join seqs s on b.header = s.header join seqid i on s.sequence_align = i.sequence_align"""),
})

_A = "'-ACDEFGHIKLMNPQRSTVWY'"
VIEWS.update({
    "gsz": (("seqs",), """select coalesce(label, 'global') as grp, count(*) as n_seq from seqs group by grouping sets ((label), ())"""),
    "fi": (("sites", "gsz"), """select c.grp, c.pos, c.aa, c.n, c.n / z.n_seq as f from (
        select coalesce(label, 'global') as grp, pos, aa, count(*) as n from sites
        group by grouping sets ((label, pos, aa), (pos, aa))) c join gsz z on c.grp = z.grp"""),
    "fij": (("sites",), f"""select coalesce(x.label, 'global') as grp, x.pos as i, cast(instr({_A}, x.aa) - 1 as integer) as a,
        y.pos as j, cast(instr({_A}, y.aa) - 1 as integer) as b, count(*) as n
        from sites x join sites y on x.header = y.header and x.pos < y.pos
        group by grouping sets ((x.label, x.pos, x.aa, y.pos, y.aa), (x.pos, x.aa, y.pos, y.aa))"""),
    "gcnt": (("sites",), """select label as grp, pos, aa, count(*) as n from sites where is_train group by label, pos, aa"""),
    "gcdf": (("gcnt",), f"""select grp, pos, aa,
        sum(n) over (partition by grp, pos order by instr({_A}, aa) rows between unbounded preceding and current row) - n as lo,
        sum(n) over (partition by grp, pos order by instr({_A}, aa) rows between unbounded preceding and current row) as hi
        from gcnt"""),
    "gen": (("gcdf", "seqs"), f"""select 'gen_' || cast(row_number() over (order by label, target_idx) - 1 as varchar) as header,
        replace(sequence_align, '-', '') as sequence, sequence_align, label from (
          select d.target_id, d.label, d.target_idx, string_agg(c.aa, '' order by d.pos) as sequence_align from (
            select t.*, z.pos, ((('0x' || substr(md5('11:' || t.target_id || ':' || cast(z.pos as varchar)), 1, 8))::bigint)
                   * z.N) // 4294967296 as r
            from (select l.label, cast(r.i as integer) as target_idx, l.label || ':' || cast(r.i as varchar) as target_id
                  from (select distinct label from seqs where is_train) l, range(0, 1000) r(i)) t
            join (select grp, pos, max(hi) as N from gcdf group by grp, pos) z on z.grp = t.label) d
          join gcdf c on c.grp = d.label and c.pos = d.pos and d.r >= c.lo and d.r < c.hi
          group by d.target_id, d.label, d.target_idx) g"""),
})


def pearson_sql(data_sites: str, model_sites: str) -> str:
    """SQL body computing the Cij Pearson per group between two site views (header, label, pos, aa)."""
    L, Qn = 64, 21
    n = L * (L - 1) // 2 * Qn * Qn
    return f"""
    dsz as (select coalesce(label, 'global') as grp, count(distinct header) as n_seq from {data_sites}
            group by grouping sets ((label), ())),
    msz as (select coalesce(label, 'global') as grp, count(distinct header) as n_seq from {model_sites}
            group by grouping sets ((label), ())),
    dfi as (select c.grp, c.pos, c.a, c.n / z.n_seq as f from (select coalesce(label, 'global') as grp, pos,
            cast(instr({_A}, aa) - 1 as integer) as a, count(*) as n from {data_sites} group by grouping sets ((label, pos, aa), (pos, aa))) c
            join dsz z on c.grp = z.grp),
    mfi as (select c.grp, c.pos, c.a, c.n / z.n_seq as f from (select coalesce(label, 'global') as grp, pos,
            cast(instr({_A}, aa) - 1 as integer) as a, count(*) as n from {model_sites} group by grouping sets ((label, pos, aa), (pos, aa))) c
            join msz z on c.grp = z.grp),
    dfij as (select c.grp, c.i, c.a, c.j, c.b, c.n / z.n_seq as f from (select coalesce(x.label, 'global') as grp, x.pos as i,
            cast(instr({_A}, x.aa) - 1 as integer) as a, y.pos as j, cast(instr({_A}, y.aa) - 1 as integer) as b, count(*) as n
            from {data_sites} x join {data_sites} y on x.header = y.header and x.pos < y.pos
            group by grouping sets ((x.label, x.pos, x.aa, y.pos, y.aa), (x.pos, x.aa, y.pos, y.aa))) c join dsz z on c.grp = z.grp),
    mfij as (select c.grp, c.i, c.a, c.j, c.b, c.n / z.n_seq as f from (select coalesce(x.label, 'global') as grp, x.pos as i,
            cast(instr({_A}, x.aa) - 1 as integer) as a, y.pos as j, cast(instr({_A}, y.aa) - 1 as integer) as b, count(*) as n
            from {model_sites} x join {model_sites} y on x.header = y.header and x.pos < y.pos
            group by grouping sets ((x.label, x.pos, x.aa, y.pos, y.aa), (x.pos, x.aa, y.pos, y.aa))) c join msz z on c.grp = z.grp),
    fi2 as (select coalesce(d.grp, m.grp) as grp, coalesce(d.pos, m.pos) as pos, coalesce(d.a, m.a) as a,
            coalesce(d.f, 0) as fd, coalesce(m.f, 0) as fm from dfi d full outer join mfi m on d.grp = m.grp and d.pos = m.pos and d.a = m.a),
    cells as (select l.grp, l.pos as i, l.a, r.pos as j, r.a as b, l.fd as fdi, l.fm as fmi, r.fd as fdj, r.fm as fmj
            from fi2 l join fi2 r on l.grp = r.grp and l.pos < r.pos),
    xy as (select c.grp, coalesce(d.f, 0) - c.fdi * c.fdj as x, coalesce(m.f, 0) - c.fmi * c.fmj as y from cells c
            left join dfij d on d.grp = c.grp and d.i = c.i and d.a = c.a and d.j = c.j and d.b = c.b
            left join mfij m on m.grp = c.grp and m.i = c.i and m.a = c.a and m.j = c.j and m.b = c.b),
    mo as (select grp, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx, sum(y * y) as syy from xy group by grp)
    select grp as label, round((sxy - sx * sy / {n}.0) / sqrt((sxx - sx * sx / {n}.0) * (syy - sy * sy / {n}.0)), 6) as pearson from mo"""

VIEWS.update({
    "emb": ((), """select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as dim,
        cast(unnest(embedding) as double) as x from embeddings"""),
    "w1": ((), """select cast(d.i as integer) as dim, cast(h.i as integer) as h, ((d.i * 31 + h.i * 17) % 101 - 50) / 250.0e0 as w
        from range(0, 64) d(i), range(0, 16) h(i)"""),
    "w2": ((), """select cast(h.i as integer) as h, cast(o.i as integer) as o, ((h.i * 13 + o.i * 7) % 53 - 26) / 100.0e0 as w
        from range(0, 16) h(i), range(0, 8) o(i)"""),
    "embn": (("emb",), """select e.vec_id, e.label, e.dim, e.x / n.norm as x from emb e
        join (select vec_id, sqrt(sum(x * x)) as norm from emb group by vec_id) n on e.vec_id = n.vec_id"""),
})
