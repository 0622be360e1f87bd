"""Specification values, tables and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import fixed, specs
from forecourt.operators import catalog, pages
from forecourt.plans.bindings import spec_pages, spec_texts, spec_texts_sql, table
from forecourt.plans.registry import query
from forecourt.session import cut_lineage
from forecourt.sources.tables import empty_catalog

SPECS = spec_texts_sql()


def _group(key, pattern, group=1):
    return f"regexp_extract(raw_text, '(?i){pattern}', {group})"


@query(f"""select page_id, key, case when regexp_matches(raw_text, '^\\s*([\\d.,]+)\\s*([^\\d\\s].*)?$') then
    try_cast(replace(regexp_extract(raw_text, '^\\s*([\\d.,]+)', 1), ',', '') as double) end as value_num,
  case when not regexp_matches(raw_text, '^\\s*([\\d.,]+)\\s*([^\\d\\s].*)?$') then trim(raw_text) end as value_text,
  case when regexp_matches(raw_text, '^\\s*([\\d.,]+)\\s*([^\\d\\s].*)?$') then
    nullif(rtrim(trim(split_part(regexp_extract(raw_text, '^\\s*([\\d.,]+)\\s*([^\\d\\s].*)?$', 2), '@', 1)), '.,;:'), '') end as unit
from ({SPECS}) s""")
def value_unit_split(spark, sf_dir):
    rows = spec_texts(spark, sf_dir)
    return rows.select("page_id", "key", specs.value_and_unit(F.col("raw_text")).alias("v")).select("page_id", "key", "v.*")


def _parsed(spark, sf_dir, key, function):
    rows = spec_texts(spark, sf_dir).filter(F.col("key") == key)
    return rows.select("page_id", function(F.col("raw_text")).alias("v")).select("page_id", "v.*")


@query(f"""select page_id, cast({_group("power", "(\\d+)\\s*kw")} as int) as kw, cast({_group("power", "(\\d+)\\s*hp")} as int) as hp,
  cast({_group("power", "(\\d+)\\s*bhp")} as int) as bhp, cast({_group("power", "@\\s*(\\d+)\\s*rpm")} as int) as rpm
from ({SPECS}) s where key = 'power'""")
def unit_power(spark, sf_dir):
    return _parsed(spark, sf_dir, "power", specs.power)


@query(f"""select page_id, cast({_group("t", "(\\d+)\\s*lb[- ]ft")} as int) as lb_ft, cast({_group("t", "(\\d+)\\s*nm")} as int) as nm,
  cast({_group("t", "@\\s*(\\d+)[-–](\\d+)\\s*rpm")} as int) as rpm_min, cast({_group("t", "@\\s*(\\d+)[-–](\\d+)\\s*rpm", 2)} as int) as rpm_max
from ({SPECS}) s where key = 'torque'""")
def unit_torque(spark, sf_dir):
    return _parsed(spark, sf_dir, "torque", specs.torque)


@query(f"""select page_id, cast({_group("d", "(\\d+)\\s*mm")} as int) as mm, cast({_group("d", "([\\d.]+)\\s*in")} as double) as "in"
from ({SPECS}) s where key = 'length'""")
def unit_dimension(spark, sf_dir):
    return _parsed(spark, sf_dir, "length", specs.dimension)


@query(f"""select page_id, cast({_group("d", "([\\d.]+)\\s*l\\b")} as double) as l, cast({_group("d", "([\\d.]+)\\s*gal")} as double) as gal
from ({SPECS}) s where key = 'fuel_tank_capacity'""")
def unit_fuel_capacity(spark, sf_dir):
    return _parsed(spark, sf_dir, "fuel_tank_capacity", specs.fuel_capacity)


@query(f"""select page_id, cast({_group("d", "([\\d.]+)\\s*mpg")} as double) as mpg, cast({_group("d", "([\\d.]+)\\s*l/100")} as double) as l_100km
from ({SPECS}) s where key = 'city_fuel_consumption'""")
def unit_fuel_economy(spark, sf_dir):
    return _parsed(spark, sf_dir, "city_fuel_consumption", specs.fuel_economy)


@query(f"""select page_id, cast({_group("d", "(\\d+)\\s*kg")} as int) as kg, cast(replace({_group("d", "([\\d,]+)\\s*lbs")}, ',', '') as int) as lbs
from ({SPECS}) s where key = 'unladen_weight'""")
def unit_weight(spark, sf_dir):
    return _parsed(spark, sf_dir, "unladen_weight", specs.weight)


WIDE = ["cylinders", "fuel_type", "displacement_cc", "displacement_l", "power_hp", "power_kw", "power_bhp", "power_rpm",
        "torque_nm", "torque_lb_ft", "torque_rpm_min", "torque_rpm_max", "length_mm", "length_in", "fuel_capacity_l",
        "fuel_capacity_gal", "fuel_economy_city_mpg", "unladen_weight_kg", "unladen_weight_lbs", "top_speed_kph",
        "top_speed_mph", "acceleration_0_100_kph", "acceleration_0_60_mph"]


@query("""select p_partkey as page_id, concat('V', cast(4 + p_size % 5 as string)) as cylinders, case when p_size % 2 = 0 then 'Petrol' else 'Diesel' end as fuel_type,
  1000 + p_size * 50 as displacement_cc, round((1000 + p_size * 50) / 1000.0, 1) as displacement_l, 80 + p_size as power_hp, 60 + p_size as power_kw,
  79 + p_size as power_bhp, 6000 as power_rpm, 140 + p_size as torque_nm, 100 + p_size as torque_lb_ft, 1800 as torque_rpm_min, 4000 + p_size as torque_rpm_max,
  4000 + p_size as length_mm, cast(floor(p_retailprice) as bigint) % 90 + 100.5 as length_in, cast(40 + p_size as double) as fuel_capacity_l, 10 + p_size % 10 + 0.5 as fuel_capacity_gal,
  10 + p_size + 0.9 as fuel_economy_city_mpg, 1000 + p_size as unladen_weight_kg, (2 + p_size % 3) * 1000 + 100 + p_size as unladen_weight_lbs,
  case when p_size % 4 = 0 then cast(trunc((180 + p_size) / 0.621371) as int) else 180 + p_size end as top_speed_kph,
  case when p_size % 4 = 0 then 180 + p_size else cast(trunc((180 + p_size) * 0.621371) as int) end as top_speed_mph,
  round(3 + p_size % 8 + (p_size % 10) / 10.0, 2) as acceleration_0_100_kph, round(3 + p_size % 8 + (p_size % 10) / 10.0, 2) as acceleration_0_60_mph from part""")
def spec_wide(spark, sf_dir):
    wide = catalog.wide_specs(spec_texts(spark, sf_dir))
    kinds = dict(wide.dtypes)
    plain = lambda c: F.round(F.col(c).cast("double"), 2).alias(c) if kinds[c] == "float" else F.col(c)
    return wide.select("page_id", *[plain(c) for c in WIDE])


@query("""select p_partkey as page_id, 60 + p_size as horsepower, 6000 as horsepower_rpm, 100 + p_size as torque, 1800 as torque_rpm_min,
  4000 + p_size as torque_rpm_max, 1000 + p_size * 50 as displacement, 180 + p_size as top_speed,
  cast(cast(cast(floor(p_retailprice) as bigint) % 90 + 100 as string) || '5' as int) as length_mm, cast((2 + p_size % 3) * 1000 + 100 + p_size as int) as unladen_weight_kg,
  10 + p_size % 10 + 0.5 as fuel_capacity, 10 + p_size + 0.9 as fuel_economy_city, concat('V', cast(4 + p_size % 5 as string)) as cylinders, case when p_size % 2 = 0 then 'Petrol' else 'Diesel' end as fuel_type,
  concat('{"acceleration_0-62_mph_0-100_kph":"', cast(3 + p_size % 8 as string), '.', cast(p_size % 10 as string), ' sec","special_edition":"', p_name, '"}') as extra from part""")
def legacy_specs(spark, sf_dir):
    out = catalog.legacy_specs(spec_texts(spark, sf_dir), ["page_id"])
    return out.select(
        "page_id", "horsepower", "horsepower_rpm", "torque", "torque_rpm_min", "torque_rpm_max", "displacement", "top_speed",
        "length_mm", "unladen_weight_kg", "fuel_capacity", "fuel_economy_city", "cylinders", "fuel_type", "extra",
    )


@query(f"""with x as ({SPECS}) select page_id, key, arg_min(raw_text, ord) as first_text, arg_max(raw_text, ord) as last_text from
  (select page_id, case when key = 'weight' then 'unladen_weight' else key end as key, raw_text, ord from x) y group by page_id, key""")
def flat_specs(spark, sf_dir):
    rows = spec_texts(spark, sf_dir).withColumns({
        "key": F.when(F.col("key") == "weight", F.lit("unladen_weight")).otherwise(F.col("key")),
        "block_idx": F.col("ord"), "category": F.concat(F.lit("c"), F.col("ord").cast("string")),
        "value_num": F.lit(None).cast("double"), "value_text": F.col("raw_text"), "unit": F.lit(None).cast("string"),
    })
    return catalog.flat_specs(rows).select(
        "page_id", "key", F.col("first.raw_text").alias("first_text"), F.col("last.raw_text").alias("last_text")
    )


@query("""select p_partkey, replace(lower(p_name), ' ', '_') || '_min' as key, lower(p_type) || '_' || lower(p_brand) as category,
  1990 + p_size as start_year, case when p_size % 2 = 0 then 1995 + p_size end as end_year, p_type as brand, p_name_1 as model, p_brand as generation,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as version_name, 'VERSION ' || upper(p_name) as shouted
from (select *, split_part(p_name, ' ', 1) as p_name_1 from part)""")
def spec_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" (Min):"))
    years = specs.year_span(F.concat(
        F.lit("X "), (F.col("p_size") + 1990).cast("string"), F.lit("-"),
        F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1995).cast("string")).otherwise(F.lit("present")),
    ))
    title = specs.title_parts(F.concat("p_type", F.lit(" "), F.substring_index("p_name", " ", 1), F.lit(" ("), "p_brand", F.lit(") review")))
    anchor = F.concat(F.lit("aeng_"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return part.select(
        "p_partkey", specs.normal_key(name).alias("key"),
        specs.normal_category(F.concat(F.lit(" "), "p_type", F.lit(" "), "p_brand"), F.lit(0)).alias("category"),
        years["start_year"].alias("start_year"), years["end_year"].alias("end_year"),
        title["brand"].alias("brand"), title["model"].alias("model"), title["generation"].alias("generation"),
        specs.version_name(F.lit(None).cast("string"), anchor, F.lit(1)).alias("version_name"),
        F.upper(F.concat(F.lit("Version "), "p_name")).alias("shouted"),
    )


@query("""select page_id, cast(block_idx + part as int) as block_idx, case when part = 1 then 'block_' || (block_idx + part) else category end as category, key, raw_text from (select p_partkey as page_id, cast(0 as int) as block_idx, replace(lower(p_name), ' ', '_') || '_performance_specs:' as category, 'power' as key,
    cast(60 + p_size as string) || ' KW @ 6000 RPM' || chr(10) || cast(80 + p_size as string) || ' HP @ 6000 RPM' as raw_text from part
union all select p_partkey, 0, replace(lower(p_name), ' ', '_') || '_performance_specs:', 'top_speed', cast(180 + p_size as string) || ' km/h' from part
union all select p_partkey, 0, replace(lower(p_name), ' ', '_') || '_performance_specs:', 'displacement', cast(1000 + p_size * 50 as string) || ' cm3' from part
union all select p_partkey, 2, lower(p_type) || '_sport', 'power', cast(160 + p_size as string) || ' HP @ 6500 RPM' from part
union all select p_partkey, 2, lower(p_type) || '_sport', 'unladen_weight', cast(2000 + p_size as string) || ' lbs (' || cast(1000 + p_size as string) || ' kg)' from part) r, range(2) b(part)""")
def page_spec_rows(spark, sf_dir):
    rows = pages.elements(spec_pages(spark, sf_dir), pages.BRIEF_TAGS)
    # Every box holds one table, and both are blocks.
    return catalog.spec_rows(rows).select("page_id", "block_idx", "category", "key", "raw_text")


@query("""select p_partkey as page_id, p_name || ' seats' as feature from part union all select p_partkey, 'Cruise control' from part
union all select p_partkey, 'Big screen' from part""")
def page_features(spark, sf_dir):
    return pages.highlight_features(pages.elements(spec_pages(spark, sf_dir), pages.BRIEF_TAGS)).select("page_id", "feature")


@query("""select p_partkey as page_id, 'https://cars.example.com/p/' || p_partkey || '.jpg' as url, 'BMW ' || p_name as caption, 'apple carplay' as label from part""")
def page_gallery(spark, sf_dir):
    rows = pages.elements(spec_pages(spark, sf_dir), pages.BRIEF_TAGS)
    labels = pages.infotainment_features(rows).select("page_id", "label")
    return pages.gallery_images(rows, "https://cars.example.com").join(labels, "page_id").select("page_id", "url", "caption", "label")


@query("""select p_partkey as page_id, p_type || ' ' || (1990 + p_size) || '-present' as name, 'https://cars.example.com/' || lower(p_type) || '/' as url from part""")
def generation_links(spark, sf_dir):
    return pages.generation_links(pages.overview_elements(spec_pages(spark, sf_dir)), "https://cars.example.com").select("page_id", "name", "url")


LOADED = """with p as (select p_partkey, upper(replace(p_brand, '#', '')) as brand, p_type as model, 'G' || p_size as gen_name, p_name, p_size,
  'https://cars.example.com/' || p_partkey || '.html' as url from part),
v as (select p_partkey, 1 as n, brand, model, gen_name, p_name || ' Performance Specs:' as version_name, url || '#aeng_' || replace(p_name, ' ', '-') as url, p_size,
    80 + p_size as power_hp, 60 + p_size as power_kw, 180 + p_size as top_speed_kph, cast(null as int) as unladen_weight_kg from p
  union all select p_partkey, 2, brand, model, gen_name, model || ' Sport', url || '#aeng_' || replace(p_name, ' ', '-'), p_size, 160 + p_size, null, null, 1000 + p_size from p)"""


@query(f"""{LOADED} select brand, model, gen_name, version_name, arg_max(url, (p_partkey, n)) as url, arg_max(power_hp, (p_partkey, n)) as power_hp,
  cast(max(power_kw) as int) as power_kw, cast(max(top_speed_kph) as int) as top_speed_kph, cast(max(unladen_weight_kg) as int) as unladen_weight_kg
from v group by brand, model, gen_name, version_name""")
def catalog_load(spark, sf_dir):
    loaded = catalog.load_catalog(spec_pages(spark, sf_dir), empty_catalog(spark))
    return catalog.catalog_chain(loaded).select(
        "brand", "model", "gen_name", "version_name", "url", "power_hp", "power_kw", "top_speed_kph", "unladen_weight_kg"
    )


@query(r"""select upper(replace(p_brand, '#', '')) as brand, p_type as model, 'G' || p_size as gen_name, version_name,
  '""" + fixed.CATALOG_BASE_URL + r"""/p/' || p_partkey || '.jpg' as image_url, 'BMW ' || p_name as caption
from part, lateral (select unnest([p_name || ' Performance Specs:', p_type || ' Sport'])) v(version_name)""")
def catalog_images(spark, sf_dir):
    loaded = catalog.load_catalog(spec_pages(spark, sf_dir), empty_catalog(spark))
    return catalog.versions_with_images(loaded).select("brand", "model", "gen_name", "version_name", "image_url", "caption")


@query("""with rows as (select p_partkey as page_id, p_name, p_size, b, replace(p_name, ' ', '_') || '_performance_specs' as first_category, lower(p_type) || '_sport' as second_category from part, (values (0), (1), (2), (3)) v(b)),
lines as (select page_id, b, unnest(case when b < 2 then [
    'power=' || (60 + p_size) || ' KW @ 6000 RPM' || chr(10) || (80 + p_size) || ' HP @ 6000 RPM', 'top_speed=' || (180 + p_size) || ' km/h', 'displacement=' || (1000 + p_size * 50) || ' cm3'] else [
    'power=' || (160 + p_size) || ' HP @ 6500 RPM', 'unladen_weight=' || (2000 + p_size) || ' lbs (' || (1000 + p_size) || ' kg)'] end) as line,
  generate_subscripts(case when b < 2 then [1, 2, 3] else [1, 2] end, 1) as n from rows)
select p.p_partkey as page_id, (select string_agg(b || ' ' || line, '|' order by b, n) from lines l where l.page_id = p.p_partkey) as specs,
  'Big screen|' || p_name || ' seats|Cruise control' as features, '/p/' || p_partkey || '.jpg = BMW ' || p_name as gallery, 'apple carplay' as infotainment from part p""")
def page_bundle(spark, sf_dir):
    """Specifications, features, pictures and labels of every page, in full."""
    out = catalog.page_bundle(cut_lineage(pages.elements(spec_pages(spark, sf_dir), pages.BRIEF_TAGS)))
    line = lambda x: F.concat(x["block_idx"].cast("string"), F.lit(" "), x["key"], F.lit("="), x["raw_text"])
    shown = lambda x: F.concat(F.regexp_replace(x["url"], "^https?://[^/]*", ""), F.lit(" = "), x["caption"])
    return out.select(
        "page_id", F.array_join(F.transform("specs", line), "|").alias("specs"), F.array_join("highlight_features", "|").alias("features"),
        F.array_join(F.transform("gallery_images", shown), "|").alias("gallery"), F.array_join("infotainment", "|").alias("infotainment"),
    )


@query("""select r.r_name as region, n.n_name as nation, c.c_mktsegment as segment, count(distinct c.c_custkey) as customers, count(l_orderkey) as lines,
  round(sum(l_extendedprice), 2) as total from region r join nation n on n_regionkey = r_regionkey join customer c on c_nationkey = n_nationkey
  join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by all""")
def catalog_chain(spark, sf_dir):
    """The one-to-many chain of the catalog over the given tables, joined up from the longest one."""
    t = lambda name: table(spark, sf_dir, name)
    chain = (
        t("lineitem").select("l_orderkey", "l_extendedprice")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        # One row per customer before the chain goes on: partial sums shrink the longest table first.
        .groupBy("o_custkey").agg(F.count("l_orderkey").alias("lines"), F.sum("l_extendedprice").alias("total"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return chain.groupBy(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).agg(
        F.count("o_custkey").alias("customers"), F.sum("lines").alias("lines"), F.round(F.sum("total"), 2).alias("total")
    )


@query("""select event_type, cast(json_extract_string(props, '$.k') as int) as k, count(*) as n, round(sum(value), 2) as total from events group by all""")
def json_extra(spark, sf_dir):
    """Figures from a JSON payload column, read through a variant."""
    events = table(spark, sf_dir, "events").withColumn("extra", F.parse_json("props"))
    return events.groupBy("event_type", F.variant_get("extra", "$.k", "int").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
