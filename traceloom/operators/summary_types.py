"""Edges from package summaries to the types that their fields, parameters and returns name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceloom.scratch import materialize

# Types of the language itself.
BUILTIN = ("address", "bool", "signer", "u8", "u16", "u32", "u64", "u128", "u256", "vector")

#: What makes two type edges one, besides source and target; in this order after them.
CONTEXT = {
    "relationship": "string", "field_name": "string", "variant_name": "string", "function_name": "string", "parameter_name": "string",
    "type_argument_index": "int", "is_mutable": "boolean", "is_reference": "boolean", "declaring_type_id": "string", "declaring_field_name": "string", "type_argument_name": "string",
}
KEY = ("source", "target", *CONTEXT)


def _json(value: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(value, path, "variant"))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING or another word for a variant's own type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _children(rows: DataFrame, values: Column, **changes: Column) -> DataFrame:
    """A row for each value, in the context of the row it comes from but for the changes."""
    kept = [F.col(c) for c in ("source", *CONTEXT) if c not in changes]
    return rows.select(*kept, *(c.alias(name) for name, c in changes.items()), F.explode(values).alias("value")).select("source", *CONTEXT, "value")


def usages(modules: DataFrame) -> DataFrame:
    """(source, CONTEXT..., value): the typed places of summaries (id, functions, structs and enums as name -> JSON text).

    Fields of structs, fields of enums' variants, parameters and returns; a place without ``type_`` is none. Values are
    JSON texts. A module without an id or with empty maps has no places."""
    address, module = F.col("id.address"), F.col("id.name")
    many = "map<string,variant>"

    def members(column: str) -> DataFrame:
        return modules.select(address.alias("address"), module.alias("module"), F.explode(column).alias("name", "body")).select(
            F.concat_ws("::", F.coalesce("address", F.lit("_")), "module", "name").alias("member"), "name", "body"
        )

    def place(rows: DataFrame, source: Column, value: Column, **given: Column) -> DataFrame:
        flags = {"is_mutable": F.lit(False), "is_reference": F.lit(False)} | given
        context = [flags.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CONTEXT.items()]
        return rows.select(source.alias("source"), *context, F.to_json(value).alias("value")).where("value IS NOT NULL")

    def fields_of(rows: DataFrame, body: Column) -> DataFrame:
        fields = F.from_json(F.get_json_object(body, "$.fields.fields"), many)
        return rows.select("*", F.explode(fields).alias("field", "typed")).withColumn("type", F.try_variant_get("typed", "$.type_", "variant"))

    owner, type_ = F.concat(F.lit("type:"), F.col("member")), F.col("type")
    structs = fields_of(members("structs"), F.col("body"))
    found = place(structs, owner, type_, relationship=F.lit("field"), field_name=F.col("field"), declaring_type_id=owner, declaring_field_name=F.col("field"))
    variants = members("enums").select("member", F.explode(F.from_json(F.get_json_object("body", "$.variants"), many)).alias("variant", "inner"))
    variants = fields_of(variants.withColumn("inner", F.to_json("inner")), F.col("inner"))
    found = found.unionByName(
        place(variants, owner, type_, relationship=F.lit("variantField"), field_name=F.col("field"), variant_name=F.col("variant"), declaring_type_id=owner, declaring_field_name=F.col("field"))
    )
    functions, own = members("functions"), F.concat(F.lit("function:"), F.col("member"))
    parameters = functions.select("member", "name", F.explode(F.from_json(F.get_json_object("body", "$.parameters"), "array<variant>")).alias("p"))
    found = found.unionByName(
        place(parameters, own, F.try_variant_get("p", "$.type_", "variant"), relationship=F.lit("parameter"), parameter_name=F.try_variant_get("p", "$.name", "string"), function_name=F.col("name"))
    )
    returns = functions.select("member", "name", F.explode(F.from_json(F.get_json_object("body", "$.return_"), "array<variant>")).alias("r"))
    return found.unionByName(place(returns, own, F.col("r"), relationship=F.lit("return"), function_name=F.col("name")))


def summary_edges(places: DataFrame, known: DataFrame) -> DataFrame:
    """(KEY..., type_expression, confidence): an edge from each place to every type its value names, nested ones included.

    ``places`` are rows of ``usages``; ``known`` (address, module, name, id, parameters array<string>) has one row for each
    type of the sources. Types that it lacks become external ids. Arguments of a generic type hang on that type, by
    index and, where known, by the parameter's name; a vector's element hangs on the vector. References pass on what they
    refer to, other objects and arrays all their values; numbers, null and malformed JSON name nothing. Rounds go down
    one level of nesting each until no value is left, so their number is the depth of the deepest type."""
    known = known.select(*(F.col(c).alias("_" + c) for c in ("address", "module", "name", "id", "parameters"))).dropDuplicates(["_address", "_module", "_name"])
    frontier, edges = materialize(places.select("source", *CONTEXT, "value"), "types"), None
    edge_columns = [F.col(c) for c in KEY] + [F.col("type_expression"), F.lit("heuristic").alias("confidence")]
    while edges is None or not frontier.isEmpty():
        v = F.col("v")
        rows = frontier.withColumn("v", F.try_parse_json("value")).where("v IS NOT NULL").withColumn("kind", _kind(v))
        rows = rows.withColumn("datatype", F.when(F.col("kind") == "OBJECT", F.try_variant_get(v, "$.Datatype", "variant")))
        rows = rows.withColumn("datatype", F.when(_kind(F.col("datatype")) == "OBJECT", F.col("datatype")))
        inner, reference = _json(v, "$.vector"), F.try_variant_get(v, "$.Reference", "variant")
        form = (
            F.when(F.col("kind") == "STRING", "name").when(F.col("kind") == "ARRAY", "all").when(F.col("kind") != "OBJECT", "none")
            .when(F.col("datatype").isNotNull(), "datatype").when(inner.isNotNull(), "vector").when(_kind(reference) == "ARRAY", "reference").otherwise("all")
        )
        rows = rows.withColumn("form", form)

        name = F.try_variant_get(v, "$", "string")
        named = rows.where("form = 'name'").withColumn("type_expression", name)
        named = named.withColumn("target", F.when(name.isin(*BUILTIN), F.concat(F.lit("builtin:type:"), name)).otherwise(F.concat(F.lit("external:type:summaryType:_::summary::"), name)))

        vectors = rows.where("form = 'vector'").withColumn("type_expression", F.lit("vector")).withColumn("target", F.lit("builtin:type:vector"))

        get = lambda path: F.try_variant_get("datatype", path, "string")
        typed = rows.where("form = 'datatype'").where((_kind(F.try_variant_get("datatype", "$.module", "variant")) == "OBJECT") & (_kind(F.try_variant_get("datatype", "$.name", "variant")) == "STRING"))
        typed = typed.withColumn("address", get("$.module.address")).withColumn("module", F.coalesce(get("$.module.name"), F.lit("unknown"))).withColumn("name", get("$.name"))
        typed = typed.withColumn("type_expression", F.concat_ws("::", "address", "module", "name"))
        typed = typed.withColumn("arguments", F.from_json(_json(F.col("datatype"), "$.type_arguments"), "array<variant>"))
        typed = typed.join(known, F.col("address").eqNullSafe(F.col("_address")) & (F.col("module") == F.col("_module")) & (F.col("name") == F.col("_name")), "left")
        external = F.concat(F.lit("external:type:datatype:"), F.concat_ws("::", F.coalesce("address", F.lit("_")), "module", "name"))
        typed = typed.withColumn("target", F.coalesce("_id", external))

        found = named.select(*edge_columns).unionByName(vectors.select(*edge_columns)).unionByName(typed.select(*edge_columns))
        found = materialize(found, "edges")

        nothing = {c: F.lit(None).cast(CONTEXT[c]) for c in ("field_name", "variant_name", "function_name", "parameter_name")}
        argument = nothing | {"relationship": F.lit("genericArgument"), "is_mutable": F.lit(False), "is_reference": F.lit(False)}
        every = F.when(F.col("kind") == "ARRAY", F.from_json("value", "array<variant>")).otherwise(F.map_values(F.from_json("value", "map<string,variant>")))
        texts = lambda values: F.transform(values, lambda x: F.to_json(x))
        following = _children(rows.where("form = 'all'"), texts(every))
        mutable = F.coalesce(F.try_variant_get(v, "$.Reference[0]", "boolean"), F.lit(False))
        following = following.unionByName(
            _children(rows.where("form = 'reference'"), F.array_compact(F.array(_json(v, "$.Reference[1]"))), is_mutable=mutable, is_reference=F.lit(True))
        )
        following = following.unionByName(
            _children(vectors, F.array(inner), **(argument | {"source": F.col("target"), "type_argument_name": F.lit("T"), "type_argument_index": F.lit(None).cast("int")}))
        )
        opened = typed.select("*", F.posexplode("arguments").alias("at", "arg")).withColumn("arg", _json(F.col("arg"), "$.argument")).where("arg IS NOT NULL")
        label = F.try_element_at("_parameters", F.col("at") + 1)
        following = following.unionByName(
            _children(opened, F.array("arg"), **(argument | {"source": F.col("target"), "type_argument_index": F.col("at"), "type_argument_name": label}))
        )
        frontier = materialize(following, "types")
        edges = found if edges is None else edges.unionByName(found)
    return edges
