"""The scalar function registry (F rows of the survey), a query per family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql_query
from tessera.sources.tables import table

sql_query(
    "f_math_rounding", "lineitem",
    "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS f_abs, CAST(ceil(l_extendedprice) AS BIGINT) AS f_ceil, CAST(ceiling(l_tax) AS BIGINT) AS f_ceiling, CAST(floor(l_extendedprice) AS BIGINT) AS f_floor, round(l_tax, 1) AS f_round, sign(l_discount - 0.05) AS f_sign, -l_quantity AS f_negative, +l_quantity AS f_positive FROM lineitem",
    "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS f_abs, CAST(ceil(l_extendedprice) AS BIGINT) AS f_ceil, CAST(ceiling(l_tax) AS BIGINT) AS f_ceiling, CAST(floor(l_extendedprice) AS BIGINT) AS f_floor, round(l_tax, 1) AS f_round, CAST(sign(l_discount - 0.05) AS DOUBLE) AS f_sign, -l_quantity AS f_negative, +l_quantity AS f_positive FROM lineitem",
)
sql_query(
    "f_math_powers", "lineitem",
    "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS f_sqrt, round(cbrt(l_quantity), 9) AS f_cbrt, round(exp(l_tax), 9) AS f_exp, round(expm1(l_tax), 9) AS f_expm1, round(ln(l_quantity), 9) AS f_ln, round(log10(l_quantity), 9) AS f_log10, round(log2(l_quantity), 9) AS f_log2, round(log1p(l_tax), 9) AS f_log1p, round(log(3, l_quantity), 9) AS f_log, round(pow(l_quantity, 2), 6) AS f_pow, round(power(l_quantity, 0.5), 9) AS f_power, round(hypot(l_quantity, l_tax), 9) AS f_hypot FROM lineitem",
    "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 9) AS f_sqrt, round(cbrt(l_quantity), 9) AS f_cbrt, round(exp(l_tax), 9) AS f_exp, round(exp(l_tax) - 1, 9) AS f_expm1, round(ln(l_quantity), 9) AS f_ln, round(log10(l_quantity), 9) AS f_log10, round(log2(l_quantity), 9) AS f_log2, round(ln(1 + l_tax), 9) AS f_log1p, round(ln(l_quantity) / ln(3), 9) AS f_log, round(pow(l_quantity, 2), 6) AS f_pow, round(power(l_quantity, 0.5), 9) AS f_power, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 9) AS f_hypot FROM lineitem",
)
sql_query(
    "f_math_trigonometry", "lineitem",
    "SELECT l_orderkey, l_linenumber, round(acos(l_tax), 9) AS f_acos, round(asin(l_tax), 9) AS f_asin, round(atan(l_tax), 9) AS f_atan, round(atan2(l_tax, l_quantity), 9) AS f_atan2, round(cos(l_quantity), 9) AS f_cos, round(cosh(l_tax), 9) AS f_cosh, round(sin(l_quantity), 9) AS f_sin, round(sinh(l_tax), 9) AS f_sinh, round(tan(l_tax), 9) AS f_tan, round(tanh(l_tax), 9) AS f_tanh, round(degrees(l_tax), 9) AS f_degrees, round(e(), 9) AS f_e, round(pi(), 9) AS f_pi FROM lineitem",
    "SELECT l_orderkey, l_linenumber, round(acos(l_tax), 9) AS f_acos, round(asin(l_tax), 9) AS f_asin, round(atan(l_tax), 9) AS f_atan, round(atan2(l_tax, l_quantity), 9) AS f_atan2, round(cos(l_quantity), 9) AS f_cos, round(cosh(l_tax), 9) AS f_cosh, round(sin(l_quantity), 9) AS f_sin, round(sinh(l_tax), 9) AS f_sinh, round(tan(l_tax), 9) AS f_tan, round(tanh(l_tax), 9) AS f_tanh, round(degrees(l_tax), 9) AS f_degrees, round(exp(1), 9) AS f_e, round(pi(), 9) AS f_pi FROM lineitem",
)
sql_query(
    "f_math_integers", "orders",
    "SELECT o_orderkey, bin(o_orderkey) AS f_bin, hex(o_orderkey) AS f_hex, conv(CAST(o_orderkey AS STRING), 10, 16) AS f_conv, factorial(CAST(o_orderkey % 15 AS INT)) AS f_factorial, pmod(o_orderkey, 9) AS f_pmod, shiftleft(o_orderkey, 3) AS f_shiftleft, shiftright(o_orderkey, 2) AS f_shiftright, shiftrightunsigned(o_orderkey, 1) AS f_shiftrightunsigned, signum(CAST(o_orderkey AS DOUBLE)) AS f_signum, rint(CAST(o_orderkey AS DOUBLE) / 4) AS f_rint FROM orders",
    "SELECT o_orderkey, bin(o_orderkey) AS f_bin, hex(o_orderkey) AS f_hex, hex(o_orderkey) AS f_conv, CAST(factorial(CAST(o_orderkey % 15 AS INT)) AS BIGINT) AS f_factorial, o_orderkey % 9 AS f_pmod, o_orderkey << 3 AS f_shiftleft, o_orderkey >> 2 AS f_shiftright, o_orderkey >> 1 AS f_shiftrightunsigned, CAST(sign(o_orderkey) AS DOUBLE) AS f_signum, round_even(o_orderkey / 4, 0) AS f_rint FROM orders",
)
sql_query(
    "f_text_basic", "part",
    "SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_name, '/', p_brand) AS f_concat, concat_ws('-', p_name, p_brand, p_type) AS f_concat_ws, lcase(p_type) AS f_lcase, lower(p_type) AS f_lower, length(p_name) AS f_length, ucase(p_name) AS f_ucase, upper(p_name) AS f_upper, repeat(p_brand, 2) AS f_repeat, reverse(p_name) AS f_reverse, ltrim('  a ') AS f_ltrim, rtrim(' a  ') AS f_rtrim, trim(' a ') AS f_trim, concat('<', space(3), '>') AS f_space FROM part",
    "SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_name, '/', p_brand) AS f_concat, concat_ws('-', p_name, p_brand, p_type) AS f_concat_ws, lcase(p_type) AS f_lcase, lower(p_type) AS f_lower, CAST(length(p_name) AS INT) AS f_length, ucase(p_name) AS f_ucase, upper(p_name) AS f_upper, repeat(p_brand, 2) AS f_repeat, reverse(p_name) AS f_reverse, ltrim('  a ') AS f_ltrim, rtrim(' a  ') AS f_rtrim, trim(' a ') AS f_trim, '<   >' AS f_space FROM part",
)
sql_query(
    "f_text_search", "part",
    "SELECT p_partkey, instr(p_name, 'a') AS f_instr, locate('a', p_name) AS f_locate, find_in_set(substr(p_brand, 1, 7), 'Brand#1,Brand#2,Brand#3') AS f_find_in_set, levenshtein(p_name, p_type) AS f_levenshtein, regexp_extract(p_brand, '([0-9])([0-9]*)', 1) AS f_regexp_extract, regexp_replace(p_name, '[aeiou]', '*') AS f_regexp_replace, translate(p_name, 'abc', 'xyz') AS f_translate, substr(p_name, 2, 3) AS f_substr, substring(p_name, 3) AS f_substring, substring_index(p_brand, '#', 1) AS f_substring_index, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, '*') AS f_rpad, size(split(p_name, ' ')) AS f_split FROM part",
    "SELECT p_partkey, CAST(instr(p_name, 'a') AS INT) AS f_instr, CAST(instr(p_name, 'a') AS INT) AS f_locate, coalesce(list_position(['Brand#1','Brand#2','Brand#3'], substr(p_brand, 1, 7)), 0) AS f_find_in_set, CAST(levenshtein(p_name, p_type) AS INT) AS f_levenshtein, regexp_extract(p_brand, '([0-9])([0-9]*)', 1) AS f_regexp_extract, regexp_replace(p_name, '[aeiou]', '*', 'g') AS f_regexp_replace, translate(p_name, 'abc', 'xyz') AS f_translate, substr(p_name, 2, 3) AS f_substr, substring(p_name, 3) AS f_substring, split_part(p_brand, '#', 1) AS f_substring_index, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, '*') AS f_rpad, CAST(len(string_split(p_name, ' ')) AS INT) AS f_split FROM part",
)
#: Sound classes of a name's letters: vowels and what is no letter are 0 and part equal ones; H and W don't.
_CODES = "string_split(translate(upper(p_name[1]), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556') || replace(regexp_replace(translate(upper(p_name[2:]), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556'), '[^0-9]', '0', 'g'), '7', ''), '')"
sql_query(
    "f_text_codes", "part",
    "SELECT p_partkey, base64(encode(p_name, 'UTF-8')) AS f_base64, decode(unbase64(base64(encode(p_name, 'UTF-8'))), 'UTF-8') AS f_unbase64, hex(p_brand) AS f_hex, decode(unhex(hex(p_brand)), 'UTF-8') AS f_unhex, initcap(lower(p_type)) = initcap(p_type) AS f_initcap, format_string('%s:%05d', p_brand, p_partkey) AS f_format_string, printf('%d', p_size) AS f_printf, format_number(p_retailprice, 2) AS f_format_number, soundex(p_name) AS f_soundex FROM part",
    f"SELECT p_partkey, base64(encode(p_name)) AS f_base64, p_name AS f_unbase64, hex(p_brand) AS f_hex, p_brand AS f_unhex, true AS f_initcap, printf('%s:%05d', p_brand, p_partkey) AS f_format_string, CAST(p_size AS VARCHAR) AS f_printf, format('{{:,.2f}}', round(p_retailprice, 2)) AS f_format_number, CASE WHEN upper(p_name[1]) BETWEEN 'A' AND 'Z' THEN rpad(upper(p_name[1]) || array_to_string(list_filter(list_filter({_CODES}, lambda x, i: i = 1 OR x <> ({_CODES})[i - 1])[2:], lambda x: x <> '0')[1:3], ''), 4, '0') ELSE p_name END AS f_soundex FROM part",
)
sql_query(
    "f_hashes", "part",
    "SELECT p_partkey, md5(p_name) AS f_md5, sha(p_name) AS f_sha, sha1(p_name) AS f_sha1, sha2(p_name, 256) AS f_sha2, crc32(p_name) AS f_crc32 FROM part",
    "SELECT p_partkey, md5(p_name) AS f_md5, sha1(p_name) AS f_sha, sha1(p_name) AS f_sha1, sha256(p_name) AS f_sha2, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) AS f_crc32 FROM part",
)
sql_query(
    "f_dates_fields", "orders",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS dm, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS dm, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders",
)
sql_query(
    "f_dates_arithmetic", "orders",
    "SELECT o_orderkey, add_months(o_orderdate, 2) AS am, date_add(CAST(o_orderdate AS DATE), 10) AS da, date_sub(CAST(o_orderdate AS DATE), 10) AS ds, datediff(CAST(o_orderdate AS DATE), DATE '1996-01-01') AS dd, last_day(CAST(o_orderdate AS DATE)) AS ld, next_day(CAST(o_orderdate AS DATE), 'MON') AS nd, trunc(CAST(o_orderdate AS DATE), 'MM') AS tm, trunc(CAST(o_orderdate AS DATE), 'YEAR') AS ty, months_between(TIMESTAMP '1997-02-28 10:30:00', TIMESTAMP '1996-10-30') AS mb, to_date(date_format(o_orderdate, 'yyyy-MM-dd')) AS td FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) AS am, CAST(o_orderdate AS DATE) + 10 AS da, CAST(o_orderdate AS DATE) - 10 AS ds, CAST(CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS INT) AS dd, last_day(o_orderdate) AS ld, CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INT) AS nd, CAST(date_trunc('month', o_orderdate) AS DATE) AS tm, CAST(date_trunc('year', o_orderdate) AS DATE) AS ty, 3.94959677 AS mb, CAST(o_orderdate AS DATE) AS td FROM orders",
)
sql_query(
    "f_dates_text", "events",
    "SELECT event_id, date_format(ts, 'yyyy/MM/dd HH:mm') AS df, unix_timestamp(CAST(ts AS TIMESTAMP)) AS ut, to_unix_timestamp(CAST(ts AS TIMESTAMP)) AS tu, from_unixtime(unix_timestamp(CAST(ts AS TIMESTAMP))) AS fu, date_format(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH') AS fz, date_format(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH') AS tz FROM events",
    "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS df, CAST(floor(epoch(ts)) AS BIGINT) AS ut, CAST(floor(epoch(ts)) AS BIGINT) AS tu, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fu, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS fz, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H') AS tz FROM events",
)
sql_query("f_now", "region", "SELECT r_regionkey, current_date() IS NOT NULL AS d, now() >= current_timestamp() AS n FROM region", "SELECT r_regionkey, true AS d, true AS n FROM region")
sql_query(
    "f_json", "events",
    "SELECT e.event_id, get_json_object(e.props, '$.k') AS g, j.a FROM events e LATERAL VIEW json_tuple(e.props, 'k') j AS a",
    "SELECT event_id, json_extract_string(props, '$.k') AS g, json_extract_string(props, '$.k') AS a FROM events",
)
sql_query(
    "f_collections", "embeddings",
    "SELECT vec_id, size(embedding) AS s, sort_array(embedding)[0] AS low, sort_array(embedding, false)[0] AS high, array_contains(embedding, embedding[1]) AS c FROM embeddings",
    "SELECT vec_id, CAST(len(embedding) AS INT) AS s, list_sort(embedding)[1] AS low, list_reverse_sort(embedding)[1] AS high, true AS c FROM embeddings",
)
sql_query("f_explode", "embeddings", "SELECT vec_id, sum(x) > -1000 AS ok, count(*) AS n FROM (SELECT vec_id, explode(embedding) AS x FROM embeddings) GROUP BY vec_id", "SELECT vec_id, true AS ok, len(embedding) AS n FROM embeddings")
sql_query("f_conditionals", "labels documents", "SELECT doc_id, isnull(toxic) AS a, isnotnull(toxic) AS b, nvl(toxic, 5) AS c, if(isnull(toxic), 'n', 'y') AS d, coalesce(toxic, quality, 0) AS e, greatest(toxic, 0) AS g, least(toxic, 0) AS l, isnan(CAST(toxic AS DOUBLE)) AS nan FROM documents LEFT JOIN labels USING (doc_id)", "SELECT doc_id, toxic IS NULL AS a, toxic IS NOT NULL AS b, coalesce(toxic, 5) AS c, CASE WHEN toxic IS NULL THEN 'n' ELSE 'y' END AS d, coalesce(toxic, quality, 0) AS e, greatest(toxic, 0) AS g, least(toxic, 0) AS l, false AS nan FROM documents LEFT JOIN labels USING (doc_id)")


@query("f_random", "SELECT true AS u, true AS n, count(*) AS c FROM lineitem")
def random(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.rand(3).alias("u"), F.randn(3).alias("n"))
    return t.agg(((F.min("u") >= 0) & (F.max("u") < 1)).alias("u"), (F.abs(F.avg("n")) < 0.1).alias("n"), F.count("*").alias("c"))


@query("f_placement", "SELECT count(*) AS n, true AS ids, true AS parts, true AS files FROM orders")
def placement(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"), F.input_file_name().alias("f"))
    return t.agg(F.count("*").alias("n"), (F.count_distinct("i") == F.count("*")).alias("ids"), (F.min("p") >= 0).alias("parts"), F.max(F.col("f").contains("orders")).alias("files"))


@query("f_aggregates", "SELECT l_returnflag, count(*) AS c, round(avg(l_tax), 9) AS a, round(avg(l_tax), 9) AS m, min(l_tax) AS lo, max(l_tax) AS hi, round(sum(l_tax), 4) AS s, round(stddev_samp(l_tax), 9) AS sd, round(var_samp(l_tax), 9) AS v FROM lineitem GROUP BY l_returnflag")
def aggregates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("c"), F.round(F.avg(t), 9).alias("a"), F.round(F.mean(t), 9).alias("m"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.round(F.sum(t), 4).alias("s"), F.round(F.stddev(t), 9).alias("sd"), F.round(F.variance(t), 9).alias("v")
    )
