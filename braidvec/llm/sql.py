"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_exact_top_k"] = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint))) as vec
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.vec) = len(c.vec)
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
