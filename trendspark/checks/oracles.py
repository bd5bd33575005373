"""The registered queries as plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

from trendspark.checks import cluster_sql
from trendspark.checks.queries import STOP_WORDS, TAGS

_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)
_TAGS = ", ".join(f"('{word}', '{tag}')" for word, tag in TAGS)

_PIECES = {
    "papers": (), "bridge": ("papers",), "assign": ("bridge",), "texts": ("papers",),
    "tok": ("texts",), "grams": ("tok",), "occ": ("grams",),
    "params": ("assign",), "ctf": ("occ", "assign"), "vocab": ("ctf", "params"),
    "vtf": ("ctf", "vocab"), "totals": ("vtf",), "mean_total": ("totals",), "terms": ("vtf", "vocab", "totals", "mean_total"),
    "topw": ("terms",), "win": ("occ", "tok_n", "bridge"), "tok_n": ("texts",),
    "idfs": ("terms",), "norms": ("terms",), "wnorm": ("win", "idfs"), "sims": ("win", "terms", "norms", "wnorm"),
    "dist": ("sims",), "shares": (), "sharetopics": (), "stored": ("assign",), "kw": ("papers", "bridge"),
    "topics": ("assign",),
}

_SQL = {
    "papers": """
        select doc_id paper_id, '2309.' || lpad(cast(doc_id as varchar), 6, '0') || 'v1' arxiv_id,
               split_part(text, chr(10), 1) title,
               case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) end abstract,
               date '2017-09-12' + cast(doc_id * 7 % 2928 as int) published,
               ['doc.' || upper(lang), source] categories
        from documents""",
    "bridge": "select distinct paper_id, lower(unnest(categories)) category from papers",
    "assign": """
        select b.category, b.paper_id, cast(coalesce(e.label, -1) as int) topic
        from bridge b left join embeddings e on e.vec_id = b.paper_id""",
    "texts": "select paper_id, title || '[SEP]' || coalesce(abstract, 'None') txt from papers",
    "tok": f"""
        select * from (
          select paper_id, unnest(l) w, generate_subscripts(l, 1) - 1 at_
          from (select paper_id, regexp_extract_all(txt, '[\\p{{L}}\\p{{N}}_]{{2,}}') l from texts))
        where w not in ({_STOP})""",
    "tok_n": "select paper_id, len(regexp_extract_all(txt, '[\\p{L}\\p{N}_]{2,}')) cnt from texts",
    "grams": """
        select paper_id, w, at_, lead(w, 1) over p w2, lead(w, 2) over p w3,
               lead(at_, 1) over p at2, lead(at_, 2) over p at3
        from tok window p as (partition by paper_id order by at_)""",
    "occ": """
        select paper_id, w term, 1 n, at_ first_at, at_ last_at from grams
        union all select paper_id, w || ' ' || w2, 2, at_, at2 from grams where w2 is not null
        union all select paper_id, w || ' ' || w2 || ' ' || w3, 3, at_, at3 from grams where w3 is not null""",
    "params": """
        select category, count(*) n,
               cast(least(30, greatest(2, floor(count(*) * 0.0001::double))) as int) min_df,
               cast(floor(count(*) * 0.65::double) as bigint) max_df,
               cast(floor(10.0::double + 1.0::double / (1.0::double + exp(-0.00005::double * (count(*) - 20000)))) as int) n_neighbors,
               cast(floor(sqrt(count(*))) as int) min_cluster_size,
               cast(floor(floor(sqrt(count(*))) / 1.5::double) as int) min_samples
        from assign group by category""",
    "ctf": """
        select a.category, a.topic, o.term, count(*) tf
        from occ o join assign a using (paper_id) group by all""",
    "vocab": """
        select c.category, c.term, count(*) df, cast(sum(c.tf) as bigint) f
        from ctf c join params p using (category)
        group by c.category, c.term having count(*) between min(p.min_df) and min(p.max_df)""",
    "vtf": "select c.* from ctf c semi join vocab v using (category, term)",
    "totals": "select category, topic, sum(tf) total from vtf group by all",
    "mean_total": "select category, floor(avg(total)) a from totals group by all",
    "terms": """
        select t.category, t.topic, t.term, t.tf, ln((m.a + 1.0::double) / (v.f + 0.5::double)) idf,
               t.tf / s.total::double * ln((m.a + 1.0::double) / (v.f + 0.5::double)) score
        from vtf t join vocab v using (category, term) join totals s using (category, topic)
             join mean_total m using (category)""",
    "topw": """
        select * from (select category, topic, term, score,
          row_number() over (partition by category, topic order by round(score, 9) desc, term) rank_ from terms)
        where rank_ <= 10""",
    "win": """
        select b.category, w.paper_id, w.win, w.term, count(*) c
        from (select o.paper_id, o.term, unnest(range(
                greatest(o.last_at - 3, 0), least(o.first_at, greatest(n.cnt - 4, 0)) + 1)) win
              from occ o join tok_n n using (paper_id)) w
        join bridge b using (paper_id) group by all""",
    "idfs": "select category, term, any_value(idf) idf from terms group by all",
    "norms": "select category, topic, sqrt(sum(score * score)) norm from terms where topic >= 0 group by all",
    "wnorm": """
        select w.category, w.paper_id, w.win, sqrt(sum((w.c * i.idf) * (w.c * i.idf))) norm
        from win w join idfs i using (category, term) group by all""",
    "sims": """
        select d.category, d.paper_id, d.win, d.topic, round(d.dot / (w.norm * n.norm), 9) sim
        from (select w.category, w.paper_id, w.win, t.topic, sum(w.c * t.idf * t.score) dot
              from win w join terms t using (category, term) where t.topic >= 0 group by all) d
        join wnorm w using (category, paper_id, win) join norms n using (category, topic)
        where w.norm > 0 and n.norm > 0""",
    "dist": """
        select category, paper_id, topic, m / sum(m) over (partition by category, paper_id) p
        from (select category, paper_id, topic, sum(sim) m from sims where sim >= 0.1::double group by all)""",
    "shares": """
        select category, paper_id, topic, x / sum(x) over (partition by category, paper_id) p from (
          select 'label' || label category, vec_id paper_id, cast(topic as int) topic, x::double * x::double x from (
            select label, vec_id, generate_subscripts(embedding, 1) - 1 topic, unnest(embedding) x from embeddings)
          where x > 0)""",
    "sharetopics": """
        select category, cast(unnest(range(0, k + 1)) as int) topic
        from (select 'label' || label category, max(len(embedding)) k from embeddings group by all)""",
    "stored": """
        select category, topic, rank_, paper_id from (
          select a.category, a.topic, a.paper_id,
                 row_number() over (partition by a.category, a.topic order by d.n_chars desc, a.paper_id) rank_
          from assign a join documents d on d.doc_id = a.paper_id) where rank_ <= 5""",
    "kw": f"""
        select w token, b.category, p.published, sum(t) title_count, sum(1 - t) abstract_count, count(*) as "count"
        from (select paper_id, unnest(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]{{2,}}')) w, 1 t from papers
              union all
              select paper_id, unnest(regexp_extract_all(coalesce(abstract, ''), '[\\p{{L}}\\p{{N}}_]{{2,}}')), 0 from papers) x
        join papers p using (paper_id) join bridge b using (paper_id)
        where w not in ({_STOP}) group by all""",
    "topics": "select distinct category, topic from assign where topic >= 0",
}

_MASS = """mass as materialized (
    select category, topic, sum(p) mass, sqrt(sum(p * p)) norm from {dist} group by all),
  pairs as materialized (
    select a.category, a.topic i, b.topic j, sum(a.p * b.p) dot,
           sum(a.p / ma.mass * ln((a.p / ma.mass) / (a.p / ma.mass + b.p / mb.mass))
             + b.p / mb.mass * ln((b.p / mb.mass) / (a.p / ma.mass + b.p / mb.mass))) overlap_
    from {dist} a join {dist} b on a.category = b.category and a.paper_id = b.paper_id and a.topic < b.topic
    join mass ma on ma.category = a.category and ma.topic = a.topic
    join mass mb on mb.category = b.category and mb.topic = b.topic group by all),
  cells as (
    select x.category, x.topic i, y.topic j,
           case when mi.norm > 0 and mj.norm > 0 then coalesce(p.dot, 0) / (mi.norm * mj.norm) else 0 end cosine,
           case when mi.norm > 0 and mj.norm > 0
                then 1 - sqrt(greatest(0, ln(2) + coalesce(p.overlap_, 0) / 2)) end js
    from {topics} x join {topics} y on x.category = y.category and x.topic < y.topic
    left join pairs p on p.category = x.category and p.i = x.topic and p.j = y.topic
    left join mass mi on mi.category = x.category and mi.topic = x.topic
    left join mass mj on mj.category = y.category and mj.topic = y.topic),
  upper_ as (select category, i, j, case when js is not null then
      greatest(-1, least(1, 0.3::double * (2 * cosine - 1) + 0.7::double * (2 * js - 1))) end corr from cells),
  corr as (select category, i, j, corr from upper_ union all select category, j, i, corr from upper_
    union all select category, topic, topic, 1.0::double from {topics})"""

_SERIES = """counts as (
    select m.category, strftime(p.published, '%Y-%m') as "month", m.topic, count(*) n
    from main m join {papers} p using (paper_id) group by all),
  grid as (select x.category, x."month", t.topic from (select distinct category, "month" from counts) x
    join {topics} t using (category))
  select g.category, g."month", g.topic, coalesce(c.n, 0) n from grid g
  left join counts c on c.category = g.category and c."month" = g."month" and c.topic = g.topic"""


def _with(names: list[str], body: str, extra: str = "") -> str:
    """The pieces in order of need, then ``extra`` pieces, then the query."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _PIECES[name]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    pieces = [f"{name} as materialized ({_SQL[name]})" for name in order]
    if extra:
        pieces.append(extra)
    return "with recursive " + ",\n".join(pieces) + "\n" + body


def _runs(first: str, last: str) -> str:
    return f"published between date '{first}' and date '{last}'"


def oracle_sql() -> dict[str, str]:
    run_1 = _runs("2017-09-12", "2022-07-01")
    run_2 = _runs("2020-01-01", "2025-09-18")
    name = """topic || coalesce('_' || (select string_agg(term, '_' order by rank_) from topw w
        where w.category = s.category and w.topic = s.topic and rank_ <= 4), '')"""
    sql = {
        "record_projection": _with(["papers"], """
            select arxiv_id, title, categories[2] authors, array_to_string(categories, ',') categories,
                   strftime(published, '%Y%m%d') as "day" from papers"""),
        "day_window_scan": _with(["papers"], """
            select arxiv_id, strftime(published, '%Y%m%d') as "day" from papers
            where published between date '2017-09-19' and date '2017-09-20'"""),
        "newest_first_scan": _with(["papers"], """
            select arxiv_id, published from papers where abstract is not null
            order by published desc, arxiv_id limit 50"""),
        "id_scan": _with(["papers"], """
            select arxiv_id, title from papers where paper_id in (select doc_id from labels)"""),
        "scalar_category": _with(["papers"], """
            select arxiv_id, published, 1 n_categories, categories[2] category from papers"""),
        "paper_conversion": _with(["papers"], """
            select arxiv_id, published, title, abstract, array_to_string(categories, ',') categories from papers"""),
        "backfill_days": _with(["papers"], """
            select "day", count(*) n from (
              select unnest([published, published - 1]) as "day" from papers)
            where "day" between date '2017-09-12' and date '2025-09-17' group by all"""),
        "backfill_papers": _with(["papers"], "select arxiv_id, published, title from papers"),
        "register_unseen": _with(["papers"], f"""
            select arxiv_id, published from papers where {run_2} and not ({run_1})"""),
        "register_two_runs": _with(["papers"], f"""
            select row_number() over (order by case when {run_1} then 0 else 1 end, published, arxiv_id) paper_id,
                   arxiv_id, published from papers"""),
        "category_bridge": _with(["bridge"], "select paper_id, category from bridge"),
        "list_by_category": _with(["bridge"], """
            select paper_id, arxiv_id, published from papers
            where paper_id in (select paper_id from bridge where category = 'doc.en')
              and published between date '2019-01-01' and date '2024-12-31'
            order by published, arxiv_id limit 40 offset 5"""),
        "papers_of_category": _with(["bridge"], """
            select arxiv_id, published, title,
                   (select string_agg(category, ',' order by category) from bridge b where b.paper_id = p.paper_id) categories
            from papers p where paper_id in (select paper_id from bridge where category = 'doc.de')
              and published >= date '2018-01-01'"""),
        "papers_any_category": _with(["bridge"], """
            select arxiv_id, (select string_agg(category, ',' order by category) from bridge b where b.paper_id = p.paper_id) categories
            from (select * from papers order by published, arxiv_id offset 20) p"""),
        "snapshot_by_category": _with(["bridge"], """
            select category, count(*) n, min(published) "first", max(arxiv_id) last_id
            from bridge join papers using (paper_id) group by all"""),
        "snapshot_one_category": _with(["bridge"], """
            select category, paper_id, title from bridge join papers using (paper_id) where category = 'doc.fr'"""),
        "pending_categories": _with(["bridge"], """
            select distinct category from bridge where category not in (
              select category from bridge where paper_id in (select doc_id from labels where toxic = 1))"""),
        "category_dimension": _with(["papers"], """
            select distinct code, 'papers of ' || code description from (select unnest(categories) code from papers)"""),
        "categories_with_prefix": _with(["papers"], """
            select distinct code from (select unnest(categories) code from papers) where starts_with(code, 'doc.')"""),
        "keyword_daily_counts": _with(["kw"], """
            select token, category, published, cast(title_count as bigint) title_count,
                   cast(abstract_count as bigint) abstract_count, "count" from kw"""),
        "keyword_upsert": _with(["kw"], """
            select token, category, cast(sum(title_count * k) as bigint) title_count,
                   cast(sum(abstract_count * k) as bigint) abstract_count, cast(sum("count" * k) as bigint) as "count"
            from (select *, case when published between date '2020-01-01' and date '2022-06-30' then 2 else 1 end k from kw)
            group by token, category"""),
        "keywords_of_month": _with(["kw"], """
            select token, category, published, cast(title_count as bigint) title_count,
                   cast(abstract_count as bigint) abstract_count, "count" from kw
            where category = 'doc.en' and year(published) = 2020 and month(published) = 2"""),
        "keywords_of_day": _with(["kw"], """
            select token, category, published, cast(title_count as bigint) title_count,
                   cast(abstract_count as bigint) abstract_count, "count" from kw
            where category = 'doc.en' and published = date '2017-09-19'"""),
        "input_texts": _with(["texts"], "select paper_id, txt as text from texts"),
        "tokenised_texts": _with(["texts"], """
            select paper_id, cast(len(l) as int) n_tokens, md5(array_to_string(l, ' ')) digest
            from (select paper_id, regexp_extract_all(txt, '[\\p{L}\\p{N}_]{2,}') l from texts)"""),
        "ngram_counts": _with(["occ"], """
            select paper_id, cast(n as int) n, count(*) terms, count(distinct term) distinct_terms
            from occ group by paper_id, n"""),
        "size_parameters": _with(["params"], "select * from params"),
        "topic_sizes": _with(["assign"], """
            select category, cast(case when topic = -1 then -1 else
                     row_number() over (partition by category, topic = -1 order by n desc, topic) - 1 end as int) topic,
                   n as "count"
            from (select category, topic, count(*) n from assign group by all)"""),
        "class_term_totals": _with(["ctf"], """
            select category, topic, cast(sum(tf) as bigint) total, count(*) distinct_terms, max(tf) highest
            from ctf group by category, topic"""),
        "document_frequencies": _with(["ctf"], """
            select category, df, count(*) terms, cast(sum(f) as bigint) occurrences from (
              select category, term, count(*) df, sum(tf) f from ctf group by category, term) group by category, df"""),
        "class_tfidf": _with(["terms"], """
            select category, topic, term, tf, round(idf, 6) idf, round(score, 6) score from terms"""),
        "class_tfidf_papers": _with(["ctf", "params"], """
            select category, topic, term, tf, round(idf, 6) idf, round(tf / total::double * idf, 6) score
            from (select t.*, s.total, ln((m.a + 1.0::double) / (v.f + 0.5::double)) idf
                  from held t join vocab v using (category, term) join totals s using (category, topic)
                  join (select category, floor(avg(total)) a from totals group by all) m using (category))""", """
            vocab as materialized (
              select category, term, f
              from (select a.category, o.term, count(*) f, count(distinct a.paper_id) df
                    from occ o join (select distinct category, paper_id from assign) a using (paper_id) group by all)
              join params p using (category) where df between p.min_df and p.max_df),
            held as materialized (select c.* from ctf c semi join vocab v using (category, term)),
            totals as materialized (select category, topic, sum(tf) total from held group by all)"""),
        "topic_keywords": _with(["topw"], """
            select category, topic, cast(rank_ as int) as "rank", term, round(score, 6) score from topw"""),
        "topic_table": _with(["topw"], f"""
            select category, topic, {name} as "name", n as "count",
                   coalesce((select string_agg(term, ',' order by rank_) from topw w
                     where w.category = s.category and w.topic = s.topic), '') keywords
            from (select category, topic, count(*) n from assign where topic <> -1 group by all) s"""),
        "keyword_tag_patterns": _with(["terms"], f"""
            select category, topic, cast(rank_ as int) as "rank", term, tags, round(score, 6) score from (
              select t.*, g.tags, row_number() over (partition by category, topic order by round(score, 9) desc, term) rank_
              from terms t join tagged g using (term)
              where g.tags in ('ADJ ADJ NOUN', 'ADJ NOUN NOUN', 'NOUN NOUN NOUN', 'NOUN ADP NOUN', 'ADJ NOUN',
                               'NOUN NOUN', 'NOUN', 'PROPN', 'ADJ')) where rank_ <= 15""", f"""
            lexicon(word, tag) as (values {_TAGS}),
            tagged as materialized (
              select term, string_agg(coalesce(l.tag, case
                  when lower(w) in ('of','in','for','with','on','by','from','to','at') then 'ADP'
                  when regexp_matches(lower(w), '(ly)$') then 'ADV'
                  when regexp_matches(lower(w), '(ous|ive|al|ic|able|ible|ful|less|ary|ed)$') then 'ADJ'
                  when regexp_matches(w, '^\\p{{Lu}}') then 'PROPN' else 'NOUN' end), ' ' order by k) tags
              from (select term, unnest(l) w, generate_subscripts(l, 1) k
                    from (select term, string_split(term, ' ') l from (select distinct term from terms))) x
              left join lexicon l on l.word = lower(x.w) group by term)"""),
        "representative_docs": _with(["terms", "occ"], """
            select category, topic, cast(rank_ as int) as "rank", paper_id, round(sim, 6) sim from (
              select *, row_number() over (partition by category, topic order by sim desc nulls last, paper_id) rank_
              from doc_sims) where rank_ <= 3""", """
            chosen as materialized (select category, topic, paper_id from assign),
            paper_tf as materialized (select paper_id, term, count(*) n from occ group by all),
            doc_sims as materialized (
              select c.category, c.topic, c.paper_id,
                     round(sum(p.n * t.idf * t.score) / (sqrt(sum((p.n * t.idf) * (p.n * t.idf))) * any_value(m.norm)), 9) sim
              from chosen c join paper_tf p using (paper_id)
              join terms t on t.category = c.category and t.topic = c.topic and t.term = p.term
              join (select category, topic, sqrt(sum(score * score)) norm from terms group by all) m
                on m.category = c.category and m.topic = c.topic
              group by c.category, c.topic, c.paper_id)"""),
        "representative_papers": _with(["stored", "texts"], """
            select category, topic, cast(row_number() over (partition by category, topic order by rank_, paper_id) as int) as "rank",
                   title, strftime(published, '%Y-%m') as "year", abstract, arxiv_id
            from (select s.category, s.topic, s.rank_, l.last_id paper_id
                  from stored s join texts t using (paper_id)
                  join (select txt, max(paper_id) last_id from texts group by txt) l on l.txt = t.txt) x
            join papers p using (paper_id)
            qualify row_number() over (partition by category, topic order by rank_, paper_id) <= 3"""),
        "representative_table": _with(["stored", "texts"], """
            select category, topic, cast(count(*) as int) n_docs, md5(string_agg(txt, '|' order by rank_)) digest
            from stored join texts using (paper_id) group by category, topic"""),
        "topic_distribution": _with(["dist"], "select category, paper_id, topic, round(p, 6) p from dist"),
        "main_topics": _with(["shares"], """
            select 'label' || e.label category, e.vec_id paper_id, cast(coalesce(t.topic, 0) as int) topic
            from embeddings e left join (select * from shares qualify row_number() over (
              partition by category, paper_id order by round(p, 9) desc, topic) = 1) t on t.paper_id = e.vec_id"""),
        "topic_similarities": _with(["shares", "sharetopics"], """
            select category, i, j, round(cosine, 6) cosine, round(js, 6) js from cells""",
            _MASS.format(dist="shares", topics="sharetopics")),
        "topic_correlations": _with(["shares", "sharetopics"], """
            select category, i, j, round(corr, 6) corr from corr""",
            _MASS.format(dist="shares", topics="sharetopics")),
        "correlation_range": _with(["shares", "sharetopics"], """
            select category, round(min(corr), 6) lowest, round(max(corr), 6) highest from corr group by category""",
            _MASS.format(dist="shares", topics="sharetopics")),
        "text_topic_correlations": _with(["dist", "topics"], """
            select category, i, j, round(corr, 6) corr from corr""", _MASS.format(dist="dist", topics="topics")),
        "monthly_series": _with(["dist", "topics"], "", """
            best as (select * from dist qualify row_number() over (
              partition by category, paper_id order by round(p, 9) desc, topic) = 1),
            main as (select b.category, b.paper_id, coalesce(d.topic, 0) topic
              from bridge b left join best d on d.category = b.category and d.paper_id = b.paper_id),
            """ + _SERIES.format(papers="papers", topics="topics")),
        "monthly_series_labels": _with(["topics"], "", """
            main as (select * from assign where topic >= 0),
            """ + _SERIES.format(papers="papers", topics="topics")),
        "monthly_series_orders": """
            with main as (select o_orderstatus category, o_orderkey paper_id,
                                 cast(substr(o_orderpriority, 1, 1) as int) - 1 topic, cast(o_orderdate as date) published
                          from orders),
            topics as (select distinct category, topic from main),
            """ + _SERIES.format(papers="(select paper_id, published from main)", topics="topics"),
        "period_metadata": _with(["bridge"], """
            select category, '2025-09-18T01:02:03Z' as "lastUpdated", '0.0.2' as "dataVersion",
                   strftime(min(published), '%Y-%m') as "start", strftime(max(published), '%Y-%m') as "end"
            from bridge join papers using (paper_id) group by category"""),
        "document_shares": _with(["topw"], f"""
            select a.category, a.paper_id, a.topic, n.name_ as "name",
                   case when a.topic >= 0 then list_aggregate(list_sort([a.topic || ':0.75', (a.topic + 1) || ':0.25']), 'string_agg', ',') end shares
            from assign a
            left join (select category, topic, {name} name_ from (
                select distinct category, topic from assign where topic <> -1) s) n
              on n.category = a.category and n.topic = a.topic"""),
        "category_embeddings": _with(["bridge", "texts"], """
            select b.category, p.arxiv_id, length(t.txt) characters, length(t.txt) - length(replace(t.txt, ' ', '')) blanks
            from bridge b join papers p using (paper_id) join texts t using (paper_id)
            where b.category not in ('doc.en', 'src3') or p.published >= date '2021-01-01'"""),
        "document_info": _with(["topw", "texts"], f"""
            select a.category, a.paper_id, a.topic, n.name_ as "name", p.arxiv_id, md5(t.txt) digest
            from assign a join papers p using (paper_id) join texts t using (paper_id)
            left join (select category, topic, {name} name_ from (
                select distinct category, topic from assign where topic <> -1) s) n
              on n.category = a.category and n.topic = a.topic"""),
        "nearest_neighbours": _with(["bridge"], """
            select category, paper_id, neighbor_id, cast(rank_ as int) as "rank", round(distance, 6) distance from (
              select category, paper_id, neighbor_id, distance,
                     row_number() over (partition by category, paper_id order by distance, neighbor_id) rank_ from (
                select x.category, x.paper_id, y.paper_id neighbor_id,
                       round(1 - list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)), 9) distance
                from points x join points y on x.category = y.category and x.paper_id <> y.paper_id))
            where rank_ <= 10""", """
            points as materialized (select category, paper_id, cast(embedding as double[]) v
              from bridge join embeddings on vec_id = paper_id)"""),
        "core_distances": """
            with points as (select vec_id id, cast(embedding as double[]) v from embeddings),
            m as (select greatest(1, least(count(*) - 1, floor(floor(sqrt(count(*))) / 1.5::double))) m from points)
            select 'all' category, id paper_id, round(round(d, 9), 6) core from (
              select x.id, list_distance(x.v, y.v) d,
                     row_number() over (partition by x.id order by list_distance(x.v, y.v)) k
              from points x join points y on x.id <> y.id), m where k = m.m""",
        "similarity_graph": _with(["bridge"], """
            select category, a, b, round(sum(w) - case when count(*) > 1 then min(w) * max(w) else 0 end, 6) weight
            from (select category, least(paper_id, neighbor_id) a, greatest(paper_id, neighbor_id) b,
                         case when distance <= rho or sigma <= 0 then 1 else exp(-(distance - rho) / sigma) end w
                  from near join sigmas using (category, paper_id))
            group by category, a, b""", """
            points as materialized (select category, paper_id, cast(embedding as double[]) v
              from bridge join embeddings on vec_id = paper_id),
            near as materialized (
              select * from (
                select category, paper_id, neighbor_id, distance,
                       row_number() over (partition by category, paper_id order by distance, neighbor_id) rank_ from (
                  select x.category, x.paper_id, y.paper_id neighbor_id,
                         round(1 - list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)), 9) distance
                  from points x join points y on x.category = y.category and x.paper_id <> y.paper_id))
              where rank_ <= 10),
            bisected as (
              select category, paper_id, 0 step, 0::double lo, cast('infinity' as double) hi, 1::double mid,
                     list(distance order by distance, neighbor_id) ds,
                     coalesce(min(distance) filter (where distance > 0), 0) rho
              from near group by category, paper_id
              union all
              select category, paper_id, step + 1, case when above then lo else mid end,
                     case when above then mid else hi end,
                     case when not above and hi = cast('infinity' as double) then mid * 2
                          else (case when above then lo else mid end + case when above then mid else hi end) / 2 end, ds, rho
              from (select *, list_sum(list_transform(ds, lambda x: case when x > rho then exp(-(x - rho) / mid) else 1 end))
                              > log2(len(ds)) above from bisected)
              where step < 64),
            sigmas as materialized (
              select category, paper_id, rho, greatest(mid, list_avg(ds) * 0.001) sigma from bisected where step = 64)"""),
        "soft_membership": _with(["assign"], """
            select category, paper_id, topic, round(w / sum(w) over (partition by category, paper_id), 6) p from weights""", """
            cells as materialized (select a.category, a.paper_id, a.topic, i, x from assign a join (
                select vec_id, generate_subscripts(embedding, 1) i, cast(unnest(embedding) as double) x from embeddings) e
              on e.vec_id = a.paper_id),
            centres as materialized (select category, topic, i, avg(x) m from cells group by all),
            weights as (select c.category, c.paper_id, t.topic, exp(-sqrt(sum((c.x - t.m) * (c.x - t.m)))) w
              from cells c join centres t on t.category = c.category and t.i = c.i group by all)"""),
        "text_embeddings": _with(["papers"], """
            select paper_id, 64 dim, 1.0::double length from papers"""),
        "stored_embeddings": _with(["bridge"], """
            select category, paper_id, cast(len(embedding) as int) dim, round(cast(embedding[1] as double), 6) as "first"
            from bridge join embeddings on vec_id = paper_id"""),
        "trend_reports": _with(["topw", "stored", "texts", "topics"], f"""
            select m.category, m.papers, m."months", cast(t.n as int) topics, t.names, coalesce(s.shown, md5('')) shown,
                   '2025-09-18T01:02:03Z' updated, m."start", m."end"
            from (select category, count(*) papers, cast(count(distinct strftime(published, '%Y-%m')) as int) as "months",
                         strftime(min(published), '%Y-%m') as "start", strftime(max(published), '%Y-%m') as "end"
                  from bridge join papers using (paper_id) group by category) m
            join (select category, count(*) n, md5(string_agg(name_, '|' order by name_)) names from (
                    select category, {name} name_ from topics s) group by category) t using (category)
            left join (select s.category, md5(string_agg(p.arxiv_id, '|' order by p.arxiv_id)) shown
                  from stored s join texts t using (paper_id)
                  join (select txt, max(paper_id) last_id from texts group by txt) l on l.txt = t.txt
                  join papers p on p.paper_id = l.last_id where s.topic >= 0 group by s.category) s using (category)"""),
        "tree_weights": cluster_sql.TREE_WEIGHTS,
        "vector_clusters": cluster_sql.VECTOR_CLUSTERS,
        "cluster_sizes": cluster_sql.CLUSTER_SIZES,
        "streamed_ingest": _with(["bridge"], """
            select arxiv_id, published, category from papers join bridge using (paper_id)"""),
        "streamed_keywords": _with(["kw"], """
            select token, category, cast(sum(title_count) as bigint) title_count,
                   cast(sum(abstract_count) as bigint) abstract_count, cast(sum("count") as bigint) as "count"
            from kw group by token, category"""),
        "deep_slice": """
            select event_id, user_id, event_type from events order by user_id, event_id offset 100""",
    }
    return sql
