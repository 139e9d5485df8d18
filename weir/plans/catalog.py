"""Queries over the driver's tables: pipeline text, and the SQL that gives the same rows."""

from __future__ import annotations

_REV = "sum(cast(l_extendedprice as decimal(18,2)))"

#: name: (pipeline, SQL or None where SQL can't say it exactly)
QUERIES: dict[str, tuple[str, str | None]] = {
    # filters and search
    "where_cmp": ("from lineitem | where l_quantity>45 | cut l_orderkey,l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45"),
    "where_and_or_not": ('from orders | where (o_orderstatus=="F" or o_totalprice>=200000.) and not (o_orderkey<100) | cut o_orderkey', "SELECT o_orderkey FROM orders WHERE (o_orderstatus='F' OR o_totalprice>=200000) AND NOT o_orderkey<100"),
    "where_time": ("from orders | where o_orderdate>=1997-01-01T00:00:00Z and o_orderdate<1998-01-01T00:00:00Z | cut o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= timestamp '1997-01-01' AND o_orderdate < timestamp '1998-01-01'"),
    "where_in": ('from orders | where o_orderstatus in ["F","P"] | cut o_orderkey,o_orderstatus', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F','P')"),
    "where_regex": ("from part | where p_name ~ /^cold/ | cut p_partkey,p_name", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name,'^cold')"),
    "where_glob": ("from part | where p_name ~ *rod | cut p_partkey,p_name", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%rod'"),
    "where_implied": ("from customer | c_acctbal > 5000. | cut c_custkey", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"),
    "search_kw": ("from part | search widget", "SELECT * FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%' OR lower(p_type) LIKE '%widget%'"),
    "search_implied": ("from part | ? WIDGET", "SELECT * FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%' OR lower(p_type) LIKE '%widget%'"),
    "search_glob": ("from part | search cold*", "SELECT * FROM part WHERE p_name LIKE 'cold%' OR p_brand LIKE 'cold%' OR p_type LIKE 'cold%'"),
    "search_regex": ("from part | search /rod$/", "SELECT * FROM part WHERE regexp_matches(p_name,'rod$') OR regexp_matches(p_brand,'rod$') OR regexp_matches(p_type,'rod$')"),
    "search_logic": ("from part | search widget p_size>20 or rod not p_size>5", "SELECT * FROM part WHERE ((lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%' OR lower(p_type) LIKE '%widget%') AND p_size>20) OR ((lower(p_name) LIKE '%rod%' OR lower(p_brand) LIKE '%rod%' OR lower(p_type) LIKE '%rod%') AND NOT p_size>5)"),
    "search_number": ("from nation | search 3", "SELECT * FROM nation WHERE n_nationkey=3 OR n_regionkey=3 OR n_name LIKE '%3%'"),
    "grep_fn": ('from customer | where grep("building", c_mktsegment) | cut c_custkey', "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%building%'"),
    # projection and shaping
    "cut_expr": ("from orders | cut k:=o_orderkey,half:=o_totalprice/2", "SELECT o_orderkey AS k, o_totalprice/2 AS half FROM orders"),
    "drop_fields": ("from customer | drop c_name,c_acctbal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "put_field": ("from part | put big:=p_size>25, p_size:=p_size+1", "SELECT p_partkey, p_name, p_brand, p_type, p_size+1::BIGINT AS p_size, p_retailprice, p_size>25 AS big FROM part"),
    "put_nested": ("from nation | put a.b:=n_nationkey, a.c:=n_name | cut x:=a.b,y:=a.c", "SELECT n_nationkey AS x, n_name AS y FROM nation"),
    "rename_field": ("from nation | rename key:=n_nationkey,name:=n_name", "SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation"),
    "yield_record": ("from customer | yield {k:c_custkey,n:upper(c_name)}", "SELECT c_custkey AS k, upper(c_name) AS n FROM customer"),
    "yield_many": ("from nation | yield {k:n_nationkey}, {k:n_regionkey} | count() by k", "SELECT k, count(*) AS count FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_regionkey FROM nation) GROUP BY k"),
    "yield_spread": ("from region | yield {...this, z:r_regionkey*2}", "SELECT *, r_regionkey*2::BIGINT AS z FROM region"),
    "assert_rows": ("from nation | assert n_nationkey<20 | where error!=null | cut n_nationkey", "SELECT n_nationkey FROM nation WHERE NOT n_nationkey<20"),
    "sample_one": ("from nation | sample | count()", "SELECT 1::BIGINT AS this"),
    "shape_op": ("from lineitem | yield {q:l_quantity} | shape | t:=typeof(q) | count() by t", "SELECT 'int64' AS t, count(*) AS count FROM lineitem"),
    "explode_type": ("from nation | explode this by string as s", "SELECT n_name AS s FROM nation"),
    "fuse_two": ("from ( pool nation pool region ) | fuse", "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region"),
    "from_glob": ("from re* | count()", "SELECT count(*) AS this FROM region"),
    # aggregation
    "summarize_multi": ("from lineitem | n:=count(),q:=sum(l_quantity),lo:=min(l_extendedprice),hi:=max(l_extendedprice) by l_returnflag,l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1,2"),
    "avg_agg": ("from lineitem | a:=avg(l_linenumber) by l_returnflag | put a:=round(a*1000)", "SELECT l_returnflag, round(avg(l_linenumber)*1000) AS a FROM lineitem GROUP BY 1"),
    "summarize_where": ("from lineitem | n:=count() where l_tax>0.05, m:=count() by l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_tax>0.05) AS n, count(*) AS m FROM lineitem GROUP BY 1"),
    "count_all": ("from lineitem | count()", "SELECT count(*) AS this FROM lineitem"),
    "by_only": ("from orders | by o_orderstatus", "SELECT DISTINCT o_orderstatus FROM orders"),
    "by_expr": ("from customer | count() by seg:=lower(c_mktsegment)", "SELECT lower(c_mktsegment) AS seg, count(*) AS count FROM customer GROUP BY 1"),
    "logical_aggs": ("from lineitem | a:=and(l_quantity>0),o:=or(l_quantity>49) by l_returnflag", "SELECT l_returnflag, bool_and(l_quantity>0) AS a, bool_or(l_quantity>49) AS o FROM lineitem GROUP BY 1"),
    "union_agg": ('from orders | u:=union(o_orderstatus) by o_orderpriority | put u:=join(u,",")', "SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS u FROM orders GROUP BY 1"),
    "collect_agg": ('from orders | sort o_orderkey | c:=collect(<string>(o_orderkey)) by o_custkey | cut o_custkey, c:=join(c,",")', "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS c FROM orders GROUP BY 1"),
    "collect_map_agg": ('from nation | m:=collect_map(|{n_name:n_nationkey}|) by n_regionkey | over m with r=n_regionkey => (yield {r,k:key,v:value})', 'SELECT n_regionkey AS r, n_name AS k, n_nationkey AS v FROM nation'),
    "any_agg": ('from orders | p:=any(o_orderpriority),c:=any(o_custkey) by k:=f"{o_orderpriority}/{o_custkey}" | yield {k,same:k==f"{p}/{c}"}', "SELECT o_orderpriority || '/' || o_custkey AS k, true AS same FROM orders GROUP BY 1"),
    "dcount_small": ("from orders | d:=dcount(o_orderstatus) by o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1"),
    "dcount_agg": ('from events | d:=dcount(user_id),u:=union(user_id) by event_type | yield {event_type,close:abs(d-len(u))*10<=len(u)}', 'SELECT event_type, true AS close FROM events GROUP BY 1'),
    "fuse_agg": ("from nation | fuse(this)", "SELECT '{n_nationkey:int32,n_name:string,n_regionkey:int32}' AS this"),
    "bucket_day": ("from events | count() by ts:=bucket(ts,1d),event_type", "SELECT date_trunc('day',ts) AS ts, event_type, count(*) AS count FROM events GROUP BY 1,2"),
    "every_hour": ("from events | count() by every(1h)", "SELECT date_trunc('hour',ts) AS ts, count(*) AS count FROM events GROUP BY 1"),
    "null_key_group": ("from events | put k:=value>50. ? event_type : null | count() by k", "SELECT CASE WHEN value>50 THEN event_type END AS k, count(*) AS count FROM events GROUP BY 1"),
    # order
    "sort_multi": ('from orders | sort o_orderstatus asc, o_totalprice desc, o_orderkey | yield {o_orderkey,n:count()}', 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS n FROM orders'),
    "sort_nulls": ('from events | put k:=event_id%3==0 ? null : event_id | sort -r k, event_id | yield {event_id,n:count()}', 'SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id%3=0 THEN NULL ELSE event_id END DESC NULLS LAST, event_id DESC) AS n FROM events'),
    "sort_nulls_first": ('from events | put k:=event_id%3==0 ? null : event_id | sort -nulls first k, event_id | yield {event_id,n:count()}', 'SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id%3=0 THEN NULL ELSE event_id END NULLS FIRST, event_id) AS n FROM events'),
    "top_n": ("from orders | cut o_totalprice,o_orderkey | top 7 o_totalprice,o_orderkey", "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7"),
    "head_n": ("from events | sort event_id | head 5 | cut event_id,event_type", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5"),
    "tail_n": ("from events | sort event_id | tail 5 | cut event_id,event_type", "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 5)"),
    "uniq_count": ("from orders | cut o_orderstatus | sort o_orderstatus | uniq -c | yield {s:value.o_orderstatus,n:count}", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "uniq_adjacent": ("from events | sort event_id | cut event_type | uniq | count()", "SELECT count(*) AS this FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type"),
    "running_count": ("from events | sort event_id | yield {event_id,n:count()}", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events"),
    "running_sum": ("from events | sort event_id | put s:=sum(user_id) | cut event_id,s", "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM events"),
    "distinct_rows": ("from orders | cut o_orderstatus,o_orderpriority | by o_orderstatus,o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    # joins
    "join_inner": ("from orders | join (from customer) on o_custkey=c_custkey c_name,seg:=c_mktsegment | cut o_orderkey,c_name,seg", "SELECT o_orderkey, c_name, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey=c_custkey"),
    "join_left": ("from orders | left join (from customer | where c_acctbal>0) on o_custkey=c_custkey c_name | cut o_orderkey,c_name", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal>0) ON o_custkey=c_custkey"),
    "join_right": ("from orders | right join (from customer) on o_custkey=c_custkey o_orderkey | cut c_custkey,o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey=c_custkey"),
    "join_anti": ("from customer | anti join (from orders) on c_custkey=o_custkey | cut c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)"),
    "join_expr_key": ("from nation | join (from region) on (n_regionkey*10)=(r_regionkey*10) r_name | cut n_name,r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey*10=r_regionkey*10"),
    "join_null_key": ("from nation | put k:=n_nationkey<3 ? null : n_nationkey | join (from region | put k:=r_regionkey==0 ? null : r_regionkey) on k r_name | cut n_nationkey,r_name", "SELECT n_nationkey, r_name FROM (SELECT *, CASE WHEN n_nationkey<3 THEN NULL ELSE n_nationkey END AS k FROM nation) a JOIN (SELECT *, CASE WHEN r_regionkey=0 THEN NULL ELSE r_regionkey END AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k"),
    "join_fork": ("from orders | fork (=> cut o_custkey,o_orderkey => where o_totalprice>400000. | cut o_custkey,t:=o_totalprice) | join on o_custkey=o_custkey t", "SELECT a.o_custkey, a.o_orderkey, b.o_totalprice AS t FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey WHERE b.o_totalprice>400000"),
    # several legs
    "fork_union": ('from orders | fork (=> where o_totalprice>100000. => where o_orderstatus=="F") | cut o_orderkey', "SELECT o_orderkey FROM orders WHERE o_totalprice>100000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus='F'"),
    "switch_bool": ('from orders | switch ( case o_totalprice>200000. => yield {k:"big",o_orderkey} case o_totalprice>100000. => yield {k:"mid",o_orderkey} default => yield {k:"small",o_orderkey} )', "SELECT CASE WHEN o_totalprice>200000 THEN 'big' WHEN o_totalprice>100000 THEN 'mid' ELSE 'small' END AS k, o_orderkey FROM orders"),
    "switch_value": ('from orders | switch o_orderstatus ( case "F" => yield {o_orderkey,v:1} case "O" => yield {o_orderkey,v:2} )', "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS BIGINT) AS v FROM orders WHERE o_orderstatus IN ('F','O')"),
    "merge_legs": ('from orders | fork (=> where o_orderstatus=="F" => where o_orderstatus!="F") | merge o_orderkey | yield {o_orderkey,n:count()}', 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders'),
    # nested values
    "over_array": ("from embeddings | over embedding | n:=count()", "SELECT count(*) AS n FROM (SELECT unnest(embedding) FROM embeddings)"),
    "over_body": ("from embeddings | over embedding with id=vec_id => (where this>0 | n:=count() | yield {id,n})", "SELECT vec_id AS id, len(list_filter(embedding, lambda x: x>0)) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x>0))>0"),
    "over_body_head": ("from embeddings | over embedding with id=vec_id => (head 2 | yield {id,v:this})", "SELECT id, v FROM (SELECT vec_id AS id, unnest(embedding[1:2]) AS v FROM embeddings)"),
    "over_expr": ("from embeddings | yield {vec_id, n:(over embedding | count()), m:(over embedding | max(this))}", "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS m FROM embeddings"),
    "over_record": ("from nation | over {a:n_nationkey,b:n_regionkey} => (yield {k:key[0],v:value}) | s:=sum(v) by k", "SELECT 'a' AS k, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation UNION ALL SELECT 'b', CAST(sum(n_regionkey) AS BIGINT) FROM nation"),
    "over_map": ("from nation | over |{n_name:n_nationkey}| => (yield {key,value})", "SELECT n_name AS key, n_nationkey AS value FROM nation"),
    "slice_index": ("from embeddings | yield {vec_id, a:embedding[0], b:embedding[-1], n:len(embedding[1:5])}", "SELECT vec_id, embedding[1] AS a, embedding[-1] AS b, 4::BIGINT AS n FROM embeddings"),
    "map_fn": ("func dbl(x): (x*2) from nation | yield {n_nationkey, m:join(map([n_nationkey,n_regionkey],string_of),\"-\")}".replace("func dbl(x): (x*2) ", "func string_of(x): (<string>(x)) "), "SELECT n_nationkey, n_nationkey || '-' || n_regionkey AS m FROM nation"),
    "containment": ("from nation | where 3 in {a:n_nationkey,b:[n_regionkey]} | cut n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey=3 OR n_regionkey=3"),
    # strings
    "str_case": ("from customer | yield {c_custkey,a:lower(c_name),b:upper(c_mktsegment)}", "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b FROM customer"),
    "str_trim_len": ('from part | yield {p_partkey,t:trim("  "+p_name+" "),n:len(p_name),r:rune_len(p_name)}', "SELECT p_partkey, p_name AS t, strlen(p_name) AS n, length(p_name) AS r FROM part"),
    "str_split_join": ('from part | yield {p_partkey,j:join(split(p_name," "),"_"),n:len(split(p_name," "))}', "SELECT p_partkey, replace(p_name,' ','_') AS j, len(string_split(p_name,' ')) AS n FROM part"),
    "str_replace": ('from part | yield {p_partkey,r:replace(p_name,"o","0")}', "SELECT p_partkey, replace(p_name,'o','0') AS r FROM part"),
    "str_levenshtein": ('from part | yield {p_partkey,d:levenshtein(p_name,"cold rod")}', "SELECT p_partkey, levenshtein(p_name,'cold rod') AS d FROM part"),
    "str_regexp": ("from part | yield {p_partkey,a:regexp(/^(\\w)(\\w+)/,p_name)[1],b:regexp(/^(\\w)(\\w+)/,p_name)[2]}", r"SELECT p_partkey, regexp_extract(p_name,'^(\w)(\w+)',1) AS a, regexp_extract(p_name,'^(\w)(\w+)',2) AS b FROM part"),
    "str_regexp_replace": ('from part | yield {p_partkey,r:regexp_replace(p_name,/(\\w+) (\\w+)/,"${2} ${1}")}', r"SELECT p_partkey, regexp_replace(p_name,'(\w+) (\w+)','\2 \1','g') AS r FROM part"),
    "str_concat_f": ('from nation | yield {f:f"{n_name}/{n_regionkey}",p:n_name+"!"}', "SELECT n_name || '/' || n_regionkey AS f, n_name || '!' AS p FROM nation"),
    "str_slice": ("from nation | yield {a:n_name[0:3],b:n_name[-2:]}", "SELECT substr(n_name,1,3) AS a, right(n_name,2) AS b FROM nation"),
    "grok_fn": ('from part | yield grok("%{WORD:a} %{WORD:b}", p_name)', r"SELECT regexp_extract(p_name,'(\w+) (\w+)',1) AS a, regexp_extract(p_name,'(\w+) (\w+)',2) AS b FROM part"),
    "codecs": ("from nation | yield {n_nationkey,h:hex(<bytes>(n_name)),b:base64(<bytes>(n_name)),u:<string>(hex(hex(<bytes>(n_name)))==<bytes>(n_name))}", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b, 'true' AS u FROM nation"),
    "json_parse": ("from events | put p:=parse_zson(props) | cut event_id,k:=p.k", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events"),
    "uri_parse": ("from pages | u:=parse_uri(url) | cut page_id,host:=u.host,scheme:=u.scheme", r"SELECT page_id, regexp_extract(url,'^\w+://([^/:?#]+)',1) AS host, regexp_extract(url,'^(\w+):',1) AS scheme FROM pages"),
    # numbers and time
    "math_round": ("from customer | yield {c_custkey,c:ceil(c_acctbal),f:floor(c_acctbal),r:round(c_acctbal),a:abs(c_acctbal)}", "SELECT c_custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, sign(c_acctbal)*floor(abs(c_acctbal)+0.5) AS r, abs(c_acctbal) AS a FROM customer"),
    "math_powers": ("from part | yield {p_partkey,s:round(sqrt(p_size)*1000),l:round(log(p_size)*1000),p:pow(p_size,2)}", "SELECT p_partkey, round(sqrt(p_size)*1000) AS s, round(ln(p_size)*1000) AS l, pow(p_size,2) AS p FROM part"),
    "math_extremes": ("from lineitem | yield {a:min(l_linenumber,3),b:max(l_linenumber,3)} | count() by a,b", "SELECT least(l_linenumber,3::BIGINT) AS a, greatest(l_linenumber,3::BIGINT) AS b, count(*) AS count FROM lineitem GROUP BY 1,2"),
    "int_division": ("from orders | yield {o_orderkey,d:o_orderkey/7,m:o_orderkey%7,n:-o_orderkey/7}", "SELECT o_orderkey, o_orderkey//7 AS d, o_orderkey%7 AS m, -(o_orderkey//7) AS n FROM orders"),
    "divide_by_zero": ("from nation | put q:=10/n_regionkey | where is_error(10/n_regionkey) | cut n_nationkey", "SELECT n_nationkey FROM nation WHERE n_regionkey=0"),
    "time_arith": ("from events | yield {event_id,later:ts+1h,gap:(ts+1h)-ts}", "SELECT event_id, ts + INTERVAL 1 HOUR AS later, 3600000000000::BIGINT AS gap FROM events"),
    "strftime_fn": ('from orders | yield {o_orderkey,d:strftime("%Y-%m-%d",o_orderdate),m:strftime("%b %Y",o_orderdate)}', "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS d, strftime(o_orderdate,'%b %Y') AS m FROM orders"),
    "casts": ('from orders | yield {a:<string>(o_orderkey),b:<int64>(o_totalprice),c:<float64>(o_orderkey),d:<int64>("x"+o_orderstatus)}', "SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(trunc(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey AS DOUBLE) AS c, CAST(NULL AS BIGINT) AS d FROM orders"),
    # types, errors, structure
    "type_fns": ("from nation | yield {t:typeof(n_name),k:kind(this),i:is(n_name,<string>),h:has(n_name),m:missing(foo)} | count() by t,k,i,h,m", "SELECT 'string' AS t, 'record' AS k, true AS i, true AS h, true AS m, count(*) AS count FROM nation"),
    "coalesce_ternary": ("from events | yield {event_id,c:coalesce(event_id%2==0 ? null : event_id, -1),q:quiet(foo)}", "SELECT event_id, CASE WHEN event_id%2=0 THEN -1 ELSE event_id END AS c FROM events"),
    "compare_fn": ("from nation | yield {n_nationkey,c:compare(n_nationkey,10)}", "SELECT n_nationkey, CAST(sign(n_nationkey-10) AS BIGINT) AS c FROM nation"),
    "has_error_fn": ("from nation | where has_error(1/n_regionkey) | cut n_nationkey", "SELECT n_nationkey FROM nation WHERE n_regionkey=0"),
    "fields_fn": ("from nation | over fields(this) => (yield {f:join(this)}) | count() by f", "SELECT unnest(['n_nationkey','n_name','n_regionkey']) AS f, (SELECT count(*) FROM nation) AS count"),
    "flatten_fn": ("from nation | over flatten({a:{b:n_nationkey},c:n_regionkey}) => (yield {k:join(key,\".\"),value}) | s:=sum(value) by k", "SELECT 'a.b' AS k, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation UNION ALL SELECT 'c', CAST(sum(n_regionkey) AS BIGINT) FROM nation"),
    "unflatten_fn": ('from nation | yield unflatten([{key:"a",value:n_nationkey}]) | yield {a:this["a"]}', "SELECT n_nationkey AS a FROM nation"),
    "nest_dotted_fn": ('from nation | yield nest_dotted({"a.b":n_nationkey,"a.c":n_name}) | yield {b:a.b,c:a.c}', "SELECT n_nationkey AS b, n_name AS c FROM nation"),
    "shape_cast": ("type t={n_nationkey:string,extra:int64,n_name:string} from nation | yield cast(this,<t>) | yield {k:n_nationkey,n:n_name}", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n FROM nation"),
    "shape_fit": ("from nation | yield fit(this,<{n_name:string,extra:int64}>)", "SELECT n_name, CAST(NULL AS BIGINT) AS extra FROM nation"),
    "shape_order_fill": ("from nation | yield order(fill(this,<{z:int64}>),<{z:int64,n_name:string}>)", "SELECT CAST(NULL AS BIGINT) AS z, n_name, n_nationkey, n_regionkey FROM nation"),
    "named_type": ("type port=int32 from nation | yield {p:<port>(n_nationkey)} | yield {n:nameof(p),u:under(p),t:typeunder(p),d:typename(\"port\")==typeof(p)}", "SELECT 'port' AS n, n_nationkey AS u, 'int32' AS t, true AS d FROM nation"),
    "error_fns": ('from nation | yield {e:is_error(error("x")),m:error(n_name)} | yield {e,msg:m.message}', "SELECT true AS e, n_name AS msg FROM nation"),
    "ksuid_fn": ("from nation | yield {n:len(ksuid()),s:len(ksuid(ksuid()))} | count() by n,s", "SELECT 20::BIGINT AS n, 27::BIGINT AS s, count(*) AS count FROM nation"),
    "now_fn": ("from nation | where now()>2020-01-01T00:00:00Z | count()", "SELECT count(*) AS this FROM nation"),
    "net_fns": ('from nation | put ip:=<ip>(f"10.{n_regionkey}.0.{n_nationkey}") | yield {n_nationkey,n:<string>(network_of(ip,16)),m:cidr_match(10.1.0.0/16,ip),c:<string>(network_of(ip))}', "SELECT n_nationkey, '10.'||n_regionkey||'.0.0/16' AS n, n_regionkey=1 AS m, '10.0.0.0/8' AS c FROM nation"),
    "ip_sort": ('from orders | yield {ip:<ip>(f"10.{o_orderkey%7}.{o_orderkey%200}.{o_custkey%250}"),o_orderkey} | sort ip,o_orderkey | yield {o_orderkey,n:count()}', 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey%7, o_orderkey%200, o_custkey%250, o_orderkey) AS n FROM orders'),
    "sets_maps": ("from nation | yield {s:len(|[n_regionkey,n_regionkey,1]|),m:len(|{n_name:1,\"x\":2}|)} | count() by s,m", "SELECT CAST(CASE WHEN n_regionkey=1 THEN 1 ELSE 2 END AS BIGINT) AS s, 2::BIGINT AS m, count(*) AS count FROM nation GROUP BY 1,2"),
    "crop_fn": ("from nation | yield crop(this,<{n_name:string,extra:int64}>)", "SELECT n_name FROM nation"),
    "shape_fn": ("from nation | yield shape(this,<{n_regionkey:string,extra:int64,n_name:string}>)", "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(NULL AS BIGINT) AS extra, n_name, n_nationkey FROM nation"),
    "sum_overflow": ("from nation | s:=sum(n_nationkey>0 ? 9223372036854775000 : 5) by k:=n_nationkey>0", "SELECT n_nationkey>0 AS k, CASE WHEN count(*)=1 THEN CAST(5 AS BIGINT) END AS s FROM nation GROUP BY 1"),
    "running_overflow": ("from nation | sort n_nationkey | put s:=sum(n_nationkey<2 ? n_nationkey+1 : 9223372036854775807) | cut n_nationkey,s", "SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN CAST(3 AS BIGINT) END AS s FROM nation"),
    "join_left_unlike": ("from nation | left join (from region) on n_name=r_regionkey r_name | cut n_nationkey,r_name", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS r_name FROM nation"),
    "fork_project": ("from orders | fork (=> where o_totalprice>100000. | yield {k:o_orderkey,v:o_totalprice} => cut k:=o_custkey)", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice>100000 UNION ALL SELECT o_custkey, NULL FROM orders"),
    # declarations
    "const_decl": ("const LIMIT=3 from nation | where n_nationkey<LIMIT | cut n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey<3"),
    "func_decl": ("func half(p,d): (p/d) func quarter(p): (half(half(p,2),2)) from orders | yield {o_orderkey,q:quarter(o_orderkey)}", "SELECT o_orderkey, (o_orderkey//2)//2 AS q FROM orders"),
    "op_decl": ("op above(f,n): (where f>n) op tops(f): (above(f,300000.) | sort o_orderkey | head 5) from orders | tops(o_totalprice) | cut o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice>300000 ORDER BY 1 LIMIT 5"),
    "scope_block": ('from orders | ( const N=200000. where o_totalprice>N | cut o_orderkey )', 'SELECT o_orderkey FROM orders WHERE o_totalprice>200000'),
    # the headline shapes
    "pricing_summary": ("from lineitem | where l_shipdate<=1998-09-02T00:00:00Z | n:=count(),q:=sum(l_quantity),lo:=min(l_discount),hi:=max(l_tax) by l_returnflag,l_linestatus | sort l_returnflag,l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY 1,2"),
    "star_join": ('from orders | join (from customer | join (from nation) on c_nationkey=n_nationkey n_name) on o_custkey=c_custkey n_name | n:=count() by n_name', "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1"),
}

#: Engine-independent extras that Spark gives: name: (SQL for Spark, SQL for the oracle)
EXTRAS: dict[str, tuple[str, str]] = {
    "ext_semi_join": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey=o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey=o_custkey)"),
    "ext_full_join": ("SELECT n_nationkey, r_name FROM nation FULL JOIN region ON n_nationkey=r_regionkey", "SELECT n_nationkey, r_name FROM nation FULL JOIN region ON n_nationkey=r_regionkey"),
    "ext_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag,l_linestatus)",) * 2,
    "ext_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag,l_linestatus)",) * 2,
    "ext_rank": ("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders",) * 2,
    "ext_intersect": ("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region",) * 2,
    "ext_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region",) * 2,
}

FLAGSHIP = "pricing_summary"
