"""Scans of texts, SQL dependencies, classification and name clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sysweave.functions.values import plural_label
from sysweave.operators import similarity as sim
from sysweave.operators import sqltext as sq
from sysweave.operators import textscan as x
from sysweave.plans import views as v
from sysweave.plans.registry import query
from sysweave.session import spread

CHARS = """[ ,a-z_0-9\\.=''"+\\-*$()%]*"""


def statements(spark, sf):
    """One statement per part: a select, an insert or an update, between other words."""
    p = v.table(spark, sf, "part")
    key, brand = F.col("p_partkey").cast("string"), F.translate("p_brand", "#", "_")
    size = F.col("p_size") % 3
    sql = (
        F.when(size == 0, F.concat(F.lit("SELECT a, b from "), brand, F.lit(" where id = "), key))
        .when(size == 1, F.concat(F.lit("insert "), F.lit("x into "), brand, F.lit(" values ("), key, F.lit(")")))
        .otherwise(F.concat(F.lit("Update "), brand, F.lit(" set a = '"), key, F.lit("'")))
    )
    return p.select(
        F.col("p_partkey").alias("source"), F.concat(F.lit("<"), sql, F.lit("> & ["), "p_name", F.lit("]")).alias("text")
    )


STATEMENTS = """st as (select p_partkey source, '<'||case p_size%3
   when 0 then 'SELECT a, b from '||replace(p_brand,'#','_')||' where id = '||p_partkey
   when 1 then 'insert x into '||replace(p_brand,'#','_')||' values ('||p_partkey||')'
   else 'Update '||replace(p_brand,'#','_')||' set a = '''||p_partkey||'''' end||'> & ['||p_name||']' as text from part)"""


@query(
    "x1_find_sql",
    f"""with {STATEMENTS}
    select source, 'SELECT' kind, unnest(regexp_extract_all(text, '(?i)select\\s+{CHARS}\\s+from\\s+{CHARS}', 0)) as text from st
    union all select source, 'INSERT', unnest(regexp_extract_all(text, '(?i)insert\\s+{CHARS}\\s+into\\s+{CHARS}', 0)) from st
    union all select source, 'UPDATE', unnest(regexp_extract_all(text, '(?i)update\\s+{CHARS}\\s+set\\s+{CHARS}', 0)) from st""",
)
def find_sql(spark, sf):
    return x.find_sql(statements(spark, sf))


def notes(spark, sf):
    """Documents with a statement about themselves written below their text."""
    docs = spread(v.table(spark, sf, "documents"))
    key = F.col("doc_id").cast("string")
    change = F.concat(F.lit("update documents set n_chars = "), F.col("n_chars").cast("string"), F.lit(" where doc_id = "), key)
    ask = F.concat(F.lit("SELECT lang, n_chars FROM "), "source", F.lit(" WHERE doc_id = "), key)
    text = F.concat("text", F.lit("\n["), F.when(F.col("doc_id") % 3 == 0, change).otherwise(ask), F.lit("]"))
    return docs.select(F.col("doc_id").alias("source"), text.alias("text"))


NOTES = """n as (select doc_id, text||chr(10)||'['||case when doc_id%3=0 then 'update documents set n_chars = '||n_chars||' where doc_id = '||doc_id
   else 'SELECT lang, n_chars FROM '||source||' WHERE doc_id = '||doc_id end||']' as text from documents)"""


@query(
    "x1_find_sql_documents",
    f"""with {NOTES} select doc_id as source, 'SELECT' kind, unnest(regexp_extract_all(text, '(?i)select\\s+{CHARS}\\s+from\\s+{CHARS}', 0)) as text from n
    union all select doc_id, 'INSERT', unnest(regexp_extract_all(text, '(?i)insert\\s+{CHARS}\\s+into\\s+{CHARS}', 0)) from n
    union all select doc_id, 'UPDATE', unnest(regexp_extract_all(text, '(?i)update\\s+{CHARS}\\s+set\\s+{CHARS}', 0)) from n""",
)
def find_sql_documents(spark, sf):
    return x.find_sql(notes(spark, sf))


@query(
    "x2_clean_sql",
    """with t as (select c_nationkey as source, 'select a from '||c_mktsegment||'ZZZZZ'||c_nationkey||'ZZselect * from n'||c_nationkey as text from customer)
    select distinct source, query from (select source, unnest(regexp_split_to_array(text, 'ZZZ*')) query from t) where query <> ''""",
)
def clean_sql(spark, sf):
    cu = v.table(spark, sf, "customer")
    nation = F.col("c_nationkey").cast("string")
    text = F.concat(
        F.lit("select a from "), "c_mktsegment", F.lit("ZZZZZ"), nation, F.lit("ZZselect * from n"), nation
    )
    return x.clean_sql(cu.select(F.col("c_nationkey").alias("source"), text.alias("text")))


def queries_of_parts(spark, sf):
    p = v.table(spark, sf, "part")
    brand = F.translate("p_brand", "#", "_")
    kind = F.lower("p_type")
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size") % 4
    sql = (
        F.when(size == 0, F.concat(F.lit("select a, b from "), brand, F.lit(" x, "), kind, F.lit(" where id = "), key))
        .when(
            size == 1,
            F.concat(
                F.lit("SELECT s.a, ')(' FROM (SELECT COUNT(*) a FROM dbo."), brand, F.lit(" GROUP BY 1) s, "), kind,
                F.lit(" LEFT OUTER JOIN side AS d ON s.a = d.a WHERE q IN (select z from deep where k = "), key, F.lit(")"),
            ),
        )
        .when(size == 2, F.concat(F.lit("update "), brand, F.lit(" set a = 'from nowhere' where b = "), key))
        .otherwise(F.concat(F.lit("insert into "), kind, F.lit(" (a, b) values ('"), key, F.lit("', 2)")))
    )
    return p.select(F.col("p_partkey").alias("id"), sql.alias("query"))


DEPS_SQL = """deps as (select p_partkey id, upper(u.t) "table" from part, lateral (values
    (0, replace(p_brand,'#','_')), (0, p_type), (1, 'dbo.'||replace(p_brand,'#','_')), (1, p_type), (1, 'side'), (1, 'deep'),
    (2, replace(p_brand,'#','_')), (3, p_type)) u(m, t) where p_size%4=u.m)"""


@query("x3_table_dependencies", f"with {DEPS_SQL} select distinct * from deps")
def table_dependencies(spark, sf):
    return sq.table_dependencies(queries_of_parts(spark, sf)).select("id", "table")


@query(
    "x4_nested_queries",
    """with q as (select p_partkey id, lower(p_type) t, replace(p_brand,'#','_') b, 'select z from deep where k = '||p_partkey inn,
      'SELECT COUNT(*) a FROM dbo.'||replace(p_brand,'#','_')||' GROUP BY 1' mid from part where p_size%4=1),
    f as (select *, 'SELECT s.a, '')('' FROM ('||mid||') s, '||t||' LEFT OUTER JOIN side AS d ON s.a = d.a WHERE q IN ('||inn||')' whole from q)
    select cast(null as varchar) parent, whole sub, 0 as depth from f
    union all select whole, mid, 1 from f union all select whole, inn, 1 from f
    union all select null, 'select a, b from '||replace(p_brand,'#','_')||' x, '||lower(p_type)||' where id = '||p_partkey, 0 from part where p_size%4=0""",
)
def nested_queries(spark, sf):
    return sq.nested_queries(queries_of_parts(spark, sf)).select("parent", "sub", "depth")


CATALOG_SQL = """cat as (select 'db1' as database, upper(replace(p_brand,'#','_')) t from part where p_size < 25
    union select 'db1', upper(p_type) from part union select 'db2', upper(replace(p_brand,'#','_')) from part
    union select 'db2', x from (values ('SIDE'), ('DEEP')) d(x) union select 'db3', upper(p_type) from part where p_size > 45)"""


@query(
    "x5_query_vs_catalog",
    f"""with {DEPS_SQL}, {CATALOG_SQL}, d as (select distinct id, "table" t from deps)
    select id, database from d join cat using (t) group by id, database
    having count(*) = (select count(*) from d d2 where d2.id = d.id)""",
)
def query_vs_catalog(spark, sf):
    p = v.table(spark, sf, "part")
    brand = F.translate("p_brand", "#", "_")

    def tables(db, df, name):
        return df.select(F.lit(db).alias("database"), name.alias("table"))

    side = F.explode(F.array(F.lit("side"), F.lit("deep")))
    catalog = (
        tables("db1", p.where("p_size < 25"), brand)
        .unionByName(tables("db1", p, F.col("p_type")))
        .unionByName(tables("db2", p, brand))
        .unionByName(tables("db2", p.select("p_type").distinct(), side))
        .unionByName(tables("db3", p.where("p_size > 45"), F.col("p_type")))
    )
    deps = sq.table_dependencies(queries_of_parts(spark, sf)).select(F.col("id").alias("query"), "table")
    return sq.query_vs_catalog(deps, catalog).withColumnRenamed("query", "id")


@query(
    "x6_lineage_edges",
    f"""with {DEPS_SQL} select distinct 'query.Query=q'||id s, 'table' p, 'table.Name='||"table" o from deps""",
)
def lineage_edges(spark, sf):
    deps = sq.table_dependencies(queries_of_parts(spark, sf)).select(
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), "table"
    )
    return sq.lineage_edges(deps).select("s", "p", "o")


@query(
    "x7_find_urls",
    """select distinct page_id as source, url, length(split_part(url, '.', -1)) <= 4 as plausible
    from (select page_id, unnest(regexp_extract_all(url||' '||html, 'https?://[a-z_0-9\\.]+')) url from pages)""",
)
def find_urls(spark, sf):
    p = spread(v.table(spark, sf, "pages"))
    return x.find_urls(
        p.select(F.col("page_id").alias("source"), F.concat_ws(" ", "url", "html").alias("text"))
    )


@query(
    "x8_find_guids",
    """select distinct c_custkey as source, unnest(regexp_extract_all(t, '\\{[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}\\}')) guid from
    (select c_custkey, c_name||' {'||upper(substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12))||'} {'||h||'}' t
     from (select *, md5(c_name) h from customer))""",
)
def find_guids(spark, sf):
    cu = v.table(spark, sf, "customer").withColumn("h", F.md5("c_name"))
    cut = [F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    guid = F.upper(F.concat_ws("-", *cut))
    text = F.concat("c_name", F.lit(" {"), guid, F.lit("} {"), "h", F.lit("}"))
    return x.find_guids(cu.select(F.col("c_custkey").alias("source"), text.alias("text")))


@query(
    "x9_find_paths_linux",
    """select distinct doc_id as source, unnest(regexp_extract_all('see /corpus/'||source||'/doc'||doc_id||'.txt and '||text,
    '(?:/[-a-zA-Z0-9\\._+]{3,50}){3}')) path from documents""",
)
def find_paths_linux(spark, sf):
    docs = spread(v.table(spark, sf, "documents"))
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("see /corpus/"), "source", F.lit("/doc"), key, F.lit(".txt and "), "text"
    )
    return x.find_paths(docs.select(F.col("doc_id").alias("source"), text.alias("text")))


@query(
    "x9_find_paths_windows",
    """select p_partkey as source, 'C:\\'||split_part(p_name,' ',1)||'\\'||split_part(p_name,' ',2)||'\\f'||p_partkey path from part
    union all select p_partkey, 'D:' from part""",
)
def find_paths_windows(spark, sf):
    p = v.table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    path = F.concat(
        F.lit("=C:\\"), first, F.lit("\\"), second, F.lit("\\f"), F.col("p_partkey").cast("string"), F.lit(";D:\\lib|")
    )
    return x.find_paths(
        p.select(F.col("p_partkey").alias("source"), path.alias("text")), min_depth=2, dialect="windows"
    )


def connection_strings(spark, sf):
    s = v.table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("#conn: Server=db"), key, F.lit(";Database=base"), key, F.lit(";UID=user;PWD=p"), key,
        F.lit("| then DSN=Source"), key, F.lit("! end"),
    )
    return s.select(F.col("s_suppkey").alias("source"), text.alias("text"))


@query(
    "x10_find_dsn",
    """select s_suppkey as source, 6::bigint as "offset",
      ' Server=db'||s_suppkey||';Database=base'||s_suppkey||';UID=user;PWD=p'||s_suppkey||'| ' dsn from supplier
    union all select s_suppkey, length('#conn: Server=db;Database=base;UID=user;PWD=p| then') + 3*length(s_suppkey::varchar),
      ' DSN=Source'||s_suppkey from supplier""",
)
def find_dsn(spark, sf):
    return x.find_dsn(connection_strings(spark, sf))


@query(
    "x11_find_words",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) n from documents),
    w as (select doc_id, n, unnest(regexp_extract_all(line, '[a-zA-Z0-9]{5,}')) word, generate_subscripts(regexp_extract_all(line, '[a-zA-Z0-9]{5,}'), 1) k from l)
    select doc_id as source, n::int as line, (row_number() over (partition by doc_id order by n, k))::int hit, word from w""",
)
def find_words(spark, sf):
    docs = spread(v.table(spark, sf, "documents"))
    return x.find_words(docs.select(F.col("doc_id").alias("source"), "text"))


TEMPLATE_SQL = """q as (select case p_size%4
    when 0 then 'select a, b from '||replace(p_brand,'#','_')||' x, '||lower(p_type)||' where id = '||p_partkey
    when 1 then 'SELECT s.a, '')('' FROM (SELECT COUNT(*) a FROM dbo.'||replace(p_brand,'#','_')||' GROUP BY 1) s, '||lower(p_type)||' LEFT OUTER JOIN side AS d ON s.a = d.a WHERE q IN (select z from deep where k = '||p_partkey||')'
    when 2 then 'update '||replace(p_brand,'#','_')||' set a = ''from nowhere'' where b = '||p_partkey
    else 'insert into '||lower(p_type)||' (a, b) values ('''||p_partkey||''', 2)' end query from part)"""
VALUE_RX = "''(?:[^'']|'''')*''|\\b[0-9]+(?:\\.[0-9]+)?\\b"


@query(
    "x12_sql_templates",
    f"""with {TEMPLATE_SQL}, e as (select regexp_replace(query, '{VALUE_RX}', '?', 'g') template,
      regexp_extract_all(query, '{VALUE_RX}') vals from q),
    u as (select template, unnest(range(len(vals)))::int as position, unnest(vals) as value from e)
    select template, position, count(*) queries, count(distinct value) as values from u group by 1, 2""",
)
def sql_templates(spark, sf):
    t = sq.sql_templates(queries_of_parts(spark, sf))
    return t.select("template", "position", F.col("queries").cast("long").alias("queries"), "values")


@query(
    "x12_template_values",
    f"""with {TEMPLATE_SQL}, e as (select regexp_replace(query, '{VALUE_RX}', '?', 'g') template,
      regexp_extract_all(query, '{VALUE_RX}') vals from q),
    u as (select template, unnest(range(len(vals)))::int as position, unnest(vals) as value from e)
    select template, position, value, count(*) queries from u group by 1, 2, 3""",
)
def template_values(spark, sf):
    return sq.template_values(queries_of_parts(spark, sf))


def labelled(spark, sf):
    docs = spread(v.table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text")
    marks = v.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return docs.join(marks, "id")


BAYES_SQL = """d as (select documents.doc_id id, quality as label, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}') w
   from documents left join labels l using (doc_id)),
 g0 as (select id, label, unnest(w) gram from d union all
   select id, label, unnest(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) from d union all
   select id, label, unnest(list_transform(range(1, len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) from d),
 ga as (select id, label, gram, count(*) n from g0 group by all),
 known as (select distinct gram from ga where label is not null),
 g as (select ga.* from ga join known using (gram)),
 cl as (select label, gram, sum(n) n from g where label is not null group by all),
 lb as (select distinct label from d where label is not null),
 c as (select lb.label, known.gram, coalesce(cl.n, 0) n from known cross join lb left join cl on cl.gram=known.gram and cl.label=lb.label),
 m as (select label, ln(count(*) * 1.0 / (select count(*) from d where label is not null)) prior from d where label is not null group by label),
 tt as (select label, sum(n) total from c group by label),
 l as (select m.label, prior, total + (select count(distinct gram) from c) z from m join tt using (label)),
 gains as (select g.id, c.label, sum(g.n * ln(c.n + 1)) gain from g join c using (gram) group by 1, 2),
 sizes as (select id, sum(n) grams from g group by id),
 sc as (select d.id, l.label, prior - coalesce(grams, 0) * ln(z) + coalesce(gain, 0) score
   from d cross join l left join sizes using (id) left join gains on gains.id=d.id and gains.label=l.label)"""


@query(
    "x13_classify_buffers",
    f"with {BAYES_SQL} select id, max_by(label, round(score, 6)) predicted, round(max(score), 2) score from sc group by id",
)
def classify_buffers(spark, sf):
    """Trained on the labelled documents; all documents are classified."""
    every = spread(v.table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text")
    found = sim.classify_buffers(sim.train_bayes(labelled(spark, sf)), every)
    return found.withColumn("score", F.round("score", 2))


@query(
    "x13_word_grams",
    """with w as (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}') w from conversations),
    g as (select conv_id, turn, unnest(w) gram from w union all
      select conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) from w)
    select conv_id, turn, gram, count(*) n from g group by all""",
)
def word_grams(spark, sf):
    turns = v.table(spark, sf, "conversations")
    return sim.word_grams(turns, ["conv_id", "turn"], n_max=2)


@query(
    "x13_majority",
    """select source, predicted, n from (select source, lang predicted, count(*) n, row_number() over (partition by source order by count(*) desc, lang desc) r
    from documents group by source, lang) where r=1""",
)
def majority(spark, sf):
    docs = spread(v.table(spark, sf, "documents")).withColumnRenamed("lang", "predicted")
    return sim.majority(docs, ["source"])


@query("x14_confusion", "select quality as label, toxic predicted, count(*) n from labels group by 1, 2")
def confusion(spark, sf):
    marks = v.table(spark, sf, "labels")
    return sim.confusion(marks.select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")))


@query(
    "x15_cluster_shapes",
    """select distinct p_name as name, regexp_replace(regexp_replace(p_name, '[0-9]+', '#', 'g'), '[^-_ .#]+', 'w', 'g') as cluster from part
    union select s_name, regexp_replace(regexp_replace(s_name, '[0-9]+', '#', 'g'), '[^-_ .#]+', 'w', 'g') from supplier""",
)
def cluster_shapes(spark, sf):
    return sim.cluster_names(names(spark, sf), depth=0)


def names(spark, sf):
    p = v.table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return p.unionByName(v.table(spark, sf, "supplier").select(F.col("s_name").alias("name")))


@query(
    "x15_cluster_names",
    """with a as (select distinct name from (select p_name as name from part union all select s_name from supplier)),
    sh as (select name, regexp_replace(regexp_replace(name, '[0-9]+', '#', 'g'), '[^-_ .#]+', 'w', 'g') c,
      regexp_split_to_array(name, '[-_ .]') w from a),
    u as (select c, name, unnest(w) word, generate_subscripts(w, 1) - 1 pos from sh),
    n as (select c, pos, word, count(*) n from u group by all),
    e as (select c, pos, sum(n) total, count(*) d, round(log2(sum(n)) - sum(n*log2(n))/sum(n), 9) h from n group by c, pos),
    s as (select c, pos, round(h * (total - d) / total, 9) gain from e),
    b as (select c, pos from (select *, row_number() over (partition by c order by gain desc, pos) r from s where gain > 0) where r=1)
    select sh.name, case when b.pos is null then sh.c else sh.c||'|'||b.pos||'='||w[b.pos+1] end as cluster from sh left join b using (c)""",
)
def cluster_names(spark, sf):
    return sim.cluster_names(names(spark, sf), depth=1)


@query(
    "x16_plural_label",
    """select name, n, case when n=1 then name when right(name,1) not between 'A' and 'z' then name
      when name like '%ss' or name='s' then name||'es' when name like '%s' then name
      when name like '%y' then left(name, length(name)-1)||'ies' else name||'s' end as label
    from (select u.name, p_size n from part, lateral (values (split_part(p_name, ' ', 2)), (p_type), (split_part(p_name, ' ', 1)||'y'), (split_part(p_name, ' ', 2)||'ss'), (p_brand)) u(name)
      group by all)""",
)
def plural_labels(spark, sf):
    p = v.table(spark, sf, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    each = F.array(second, F.col("p_type"), F.concat(first, F.lit("y")), F.concat(second, F.lit("ss")), F.col("p_brand"))
    rows = p.select(F.explode(each).alias("name"), F.col("p_size").alias("n")).distinct()
    return rows.withColumn("label", plural_label(F.col("n"), F.col("name")))
