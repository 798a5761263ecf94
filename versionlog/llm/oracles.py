"""SQL for the registered queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shared(level: str, parents: str, keys: str, amount: str, weight: str) -> str:
    """Amounts of a node's children: full ones take their supply, the others share the rest by weight."""
    return f"""
        n_{level} as (select {keys}, cast(sum(supply) as bigint) as supply, {weight} as w from leaves group by all),
        a_{level} as (select n.*, {amount}),
        o_{level} as (select *, coalesce(sum(supply) over (o rows between unbounded preceding and 1 preceding), 0) as s0,
               sum(w) over (partition by {parents}) - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) as w0
            from a_{level} window o as (partition by {parents} order by supply / cast(w as double), {level})),
        f_{level} as (select *, (amount - s0) * w >= supply * w0 as full_ from o_{level}),
        r_{level} as (select *, amount - coalesce(sum(case when full_ then supply end) over (partition by {parents}), 0) as rest_,
               sum(case when not full_ then w end) over (partition by {parents}) as rest_w from f_{level}),
        s_{level} as (select *, case when not full_ then cast(rest_ * w as double) / rest_w end as share_ from r_{level}),
        t_{level} as (select *, rest_ - sum(floor(share_)) over (partition by {parents}) as over_,
               row_number() over (partition by {parents} order by round(share_ - floor(share_), 6) desc nulls last, {level}) as nth_ from s_{level}),
        g_{level} as (select {keys}, cast(case when full_ then supply
               else least(supply, floor(share_) + case when nth_ <= over_ then 1 else 0 end) end as bigint) as given from t_{level})"""


_DOMAIN = "case cast(regexp_extract(source, '[0-9]+') as int) % 4 when 0 then 'web' when 1 then 'books' when 2 then 'code' else 'forums' end"
_MIX = f"""
        with docs as (select doc_id, {_DOMAIN} as domain, lang as language, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents),
        leaves as (select domain, language, source, cast(sum(n_tokens) as bigint) as tokens, 3 * cast(sum(n_tokens) as bigint) as supply from docs group by all),
        {_shared('domain', '1', 'domain', "cast(floor((select sum(tokens) from leaves) * 0.8) as bigint) as amount from n_domain n", "case domain when 'web' then 4 when 'books' then 3 when 'code' then 2 else 1 end").strip()},
        {_shared('language', 'domain', 'domain, language', "given as amount from n_language n join g_domain using (domain)", "case language when 'en' then 6 when 'de' then 2 when 'fr' then 2 else 1 end").strip()},
        {_shared('source', 'domain, language', 'domain, language, source', "given as amount from n_source n join g_language using (domain, language)", "case source when 'src0' then 2 else 1 end").strip()},
        plan as (select domain, language, source, cast(floor(given / cast(tokens as double)) as bigint) as epochs,
               given - tokens * cast(floor(given / cast(tokens as double)) as bigint) as rest
            from leaves join g_source using (domain, language, source)),
        placed as (select d.*, epochs, rest, md5('42:' || epochs || ':' || doc_id) as place from docs d join plan using (domain, language, source)),
        run as (select *, sum(n_tokens) over (partition by domain, language, source order by place, n_tokens) as upto from placed)
        select doc_id, domain, language, source, n_tokens, unnest(range(epochs + case when rest > 0 and upto <= rest then 1 else 0 end)) as epoch from run"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents),
        g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
        from t join g on t.body = g.body""",
    "op6_mixing": _MIX,
}
