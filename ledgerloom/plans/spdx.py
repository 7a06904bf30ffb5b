"""Resolved fields as SPDX 3.0.1 elements: node rows with JSON payloads, and edge rows.

Ids are made of the artifact's id and the element's role, so that the same input gives the same document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators.graph import RELATIONS

# Properties by field; each field has its older names, too.
AI_SCALARS = {"informationAboutApplication": "ai_informationAboutApplication", "informationAboutTraining": "ai_informationAboutTraining", "limitation": "ai_limitation"}
AI_LISTS = {"domain": "ai_domain", "modelDataPreprocessing": "ai_modelDataPreprocessing", "modelExplainability": "ai_modelExplainability", "standardCompliance": "ai_standardCompliance", "typeOfModel": "ai_typeOfModel"}
AI_DICTIONARIES = {"hyperparameter": "ai_hyperparameter", "metric": "ai_metric", "metricDecisionThreshold": "ai_metricDecisionThreshold"}
DATA_TEXTS = {"dataCollectionProcess": "dataset_dataCollectionProcess", "datasetNoise": "dataset_datasetNoise", "datasetUpdateMechanism": "dataset_datasetUpdateMechanism", "intendedUse": "dataset_intendedUse"}
#: Texts that are written as lists of one.
DATA_SINGLE = {"dataPreprocessing": "dataset_dataPreprocessing", "knownBias": "dataset_knownBias"}
LICENSE_LIST, GENERATOR_MAIL = "3.25.0", "bom-generator@example.com"
COMMENTS = {"ai": "This results are generated by AI tools.", "data": "Generated automatically."}
LABELS = {"ai": "AI", "data": "Dataset"}
OLDER = {
    "informationAboutApplication": "intended_use", "informationAboutTraining": "training_information", "limitation": "limitations", "modelDataPreprocessing": "data_preprocessing", "modelExplainability": "model_explainability",
    "standardCompliance": "standard_compliance", "typeOfModel": "model_type", "hyperparameter": "hyperparameters", "metric": "performance_metrics", "metricDecisionThreshold": "decision_threshold", "autonomyType": "autonomy_type",
    "useSensitivePersonalInformation": "sensitive_personal_information", "safetyRiskAssessment": "safety_risk_assessment",
}
CONTEXT = "https://spdx.org/rdf/3.0.1/spdx-context.jsonld"
MOST_STUBS = 10

NODE = ("doc_id", "node_id", "type", "payload")


def element_id(kind: str, role: str) -> Column:
    return F.concat(F.lit(f"urn:spdx:{kind}-"), F.sha1(F.concat("artifact_id", F.lit(f"/{role}"))))


def _value(field: str) -> Column:
    names = [field, *([OLDER[field]] if field in OLDER else [])]
    return F.coalesce(*(fn.missing_to_null(F.try_element_at("fields", F.lit(n))) for n in names))


def by_artifact(bom_fields: DataFrame, names: DataFrame) -> DataFrame:
    """bom_fields and names (artifact_id, name) -> (artifact_id, name, fields map)."""
    g = bom_fields.where("value is not null").groupBy("artifact_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    empty = F.create_map().cast("map<string,string>")
    return names.join(g, "artifact_id", "left").select("artifact_id", "name", F.coalesce("fields", empty).alias("fields"))


def _node(rows: DataFrame, kind: str, node_id: Column, properties: list[Column]) -> DataFrame:
    return rows.select(F.col("artifact_id").alias("doc_id"), _element(kind, node_id, properties).alias("e")).select("doc_id", "e.*")


def _listed(field: str) -> Column:
    a = fn.split_list(_value(field))
    return F.when(F.size(a) > 0, a)


def _payload(kind: str, node_id: Column, properties: list[Column]) -> Column:
    """Every element but the creation info itself refers to it; properties without a value are left out."""
    info = [] if kind == "CreationInfo" else [element_id("CreationInfo", "creation").alias("creationInfo")]
    return F.to_json(F.struct(F.lit(kind).alias("type"), node_id.alias("spdxId" if kind != "CreationInfo" else "@id"), *info, *properties))


def _element(kind: str, node_id: Column, properties: list[Column]) -> Column:
    return F.struct(node_id.alias("node_id"), F.lit(kind).alias("type"), _payload(kind, node_id, properties).alias("payload"))


def _identified(kind: str, identifier: Column, *more: Column) -> Column:
    own = F.struct(F.lit("ExternalIdentifier").alias("type"), F.lit(kind).alias("externalIdentifierType"), *more[:1], identifier.alias("identifier"), *more[1:])
    return F.array(own).alias("externalIdentifier")


def _location(kind: str) -> Column:
    """Where the artifact is; a dataset's may be known by its URLs alone (fields ``urls.github`` and ``urls.huggingface``)."""
    known = [_value("downloadLocation"), *((_value("urls.github"), _value("urls.huggingface")) if kind == "data" else ())]
    return F.coalesce(*known, F.lit("NOASSERTION"))


def _ai_package(created: Column) -> list[Column]:
    v = _value
    return [
        element_id("Organization", "organization").alias("suppliedBy"),
        F.array(element_id("Organization", "organization")).alias("originatedBy"),
        F.coalesce(v("model_name"), "name", v("repo_id"), "artifact_id").alias("name"),
        F.when(v("releaseTime").isNotNull(), fn.normalize_timestamp(v("releaseTime"), created)).alias("releaseTime"),
        _location("ai").alias("software_downloadLocation"),
        v("packageVersion").alias("software_packageVersion"),
        fn.normalize_enum(v("primaryPurpose"), fn.PURPOSES, "model").alias("software_primaryPurpose"),
        *(v(f).alias(p) for f, p in AI_SCALARS.items()),
        *(_listed(f).alias(p) for f, p in AI_LISTS.items()),
        *(F.when(v(f).isNotNull(), fn.dictionary_entries(v(f))).alias(p) for f, p in AI_DICTIONARIES.items()),
        F.when(v("autonomyType").isNotNull(), fn.normalize_enum(v("autonomyType"), fn.PRESENCE, "noAssertion")).alias("ai_autonomyType"),
        F.when(v("useSensitivePersonalInformation").isNotNull(), fn.normalize_enum(v("useSensitivePersonalInformation"), fn.PRESENCE, "noAssertion")).alias("ai_useSensitivePersonalInformation"),
        fn.normalize_enum(v("safetyRiskAssessment"), fn.SAFETY, None).alias("ai_safetyRiskAssessment"),
        fn.normalize_timestamp(v("builtTime"), created).alias("builtTime"),
        F.lit(COMMENTS["ai"]).alias("comment"),
    ]


def _data_package(created: Column) -> list[Column]:
    v = _value
    empty = F.lit("")
    single = lambda f: F.when(v(f).isNotNull(), F.array(v(f))).otherwise(F.array().cast("array<string>"))
    return [
        F.array(element_id("Organization", "organization")).alias("originatedBy"),
        F.coalesce("name", "artifact_id").alias("name"),
        fn.normalize_timestamp(v("builtTime"), created).alias("builtTime"),
        fn.normalize_timestamp(v("releaseTime"), created).alias("releaseTime"),
        _location("data").alias("software_downloadLocation"),
        fn.normalize_enum(v("primaryPurpose"), fn.PURPOSES, "data").alias("software_primaryPurpose"),
        *(F.coalesce(v(f), empty).alias(p) for f, p in DATA_TEXTS.items()),
        *(single(f).alias(p) for f, p in DATA_SINGLE.items()),
        fn.split_list(v("anonymizationMethodUsed")).alias("dataset_anonymizationMethodUsed"),
        fn.dictionary_entries(v("sensorUsed")).alias("dataset_sensor"),
        fn.normalize_enum_list(v("datasetType"), fn.DATASET_TYPES, "other").alias("dataset_datasetType"),
        fn.normalize_enum(v("datasetAvailability"), fn.AVAILABILITY, "directDownload").alias("dataset_datasetAvailability"),
        fn.normalize_enum(v("confidentialityLevel"), fn.CONFIDENTIALITY, "clear").alias("dataset_confidentialityLevel"),
        fn.normalize_enum(v("hasSensitivePersonalInformation"), fn.PRESENCE, "no").alias("dataset_hasSensitivePersonalInformation"),
        fn.size_to_bytes(v("datasetSize")).alias("dataset_datasetSize"),
        F.lit(COMMENTS["data"]).alias("comment"),
    ]


def ai_packages(rows: DataFrame, created: Column) -> DataFrame:
    """rows (artifact_id, name, fields) -> AIPackage nodes; properties without a value are left out."""
    return _node(rows, "ai_AIPackage", element_id("AIPackage", "package"), _ai_package(created))


def data_packages(rows: DataFrame, created: Column) -> DataFrame:
    """rows -> DatasetPackage nodes; texts and lists are written even if empty, the size only if known."""
    return _node(rows, "dataset_DatasetPackage", element_id("DatasetPackage", "package"), _data_package(created))


def _stubs(field: str, relation: str, kind: str) -> tuple[Column, Column]:
    """Arrays of the stub elements that a relationship field names, and of the edges to them."""
    ai = kind == "ai"
    type_, what = ("ai_AIPackage", "model") if ai else ("dataset_DatasetPackage", "dataset")
    names = F.slice(fn.named_entities(_value(field)), 1, MOST_STUBS)

    def made(prefix: str, name: Column) -> Column:
        return F.concat(F.lit(f"urn:spdx:{prefix}-"), F.sha1(F.concat("artifact_id", F.lit(f"/{field}/"), F.lower(name))))

    def stub(name: Column) -> Column:
        props = [name.alias("name"), F.lit("NOASSERTION").alias("software_downloadLocation"), F.lit("model" if ai else "data").alias("software_primaryPurpose")]
        return _element(type_, made(type_.split("_")[1], name), props + ([] if ai else [F.array(F.lit("noAssertion")).alias("dataset_datasetType")]))

    def link(name: Column) -> Column:
        told = F.concat(F.lit(f"{relation} relationship to {what}: "), name)
        return _edge(made(f"Relationship-{relation}", name), relation, element_id("AIPackage", "package"), made(type_.split("_")[1], name), told)

    return F.transform(names, stub), F.transform(names, link)


def _edge(edge_id: Column, relation: str, from_id: Column, to_id: Column, description: Column) -> Column:
    return F.struct(edge_id.alias("edge_id"), F.lit(relation).alias("rel_type"), from_id.alias("from_id"), to_id.alias("to_id"), description.alias("description"))


def documents(rows: DataFrame, kind: str, created: Column) -> tuple[DataFrame, DataFrame]:
    """rows (artifact_id, name, fields) of one kind (ai or data) -> nodes (doc_id, node_id, type, payload, pos) and edges (doc_id,
    edge_id, rel_type, from_id, to_id, description, pos). Each is one pass over the rows.

    Names in the relationship fields become stubs, ten of each field at most; a lineage names AI packages.
    """
    if kind not in ("ai", "data", "dataset"):
        raise ValueError(kind)
    kind = "data" if kind == "dataset" else kind
    ai, label = kind == "ai", LABELS[kind]
    package = element_id("AIPackage" if ai else "DatasetPackage", "package")
    info, profile = element_id("CreationInfo", "creation"), F.array(F.lit("core"), F.lit("ai" if ai else "dataset")).alias("profileConformance")
    who = F.coalesce(_value("suppliedBy" if ai else "originatedBy"), F.lit("Unknown"))
    whose = F.coalesce(_value("repo_id"), F.col("artifact_id")) if ai else who
    where = F.lit("NOASSERTION") if ai else _location(kind)
    license_id = element_id("License", "license")
    elements = [
        _element("CreationInfo", info, [F.lit("3.0.1").alias("specVersion"), F.array(element_id("Person", "person")).alias("createdBy"), created.alias("created")]),
        _element("Person", element_id("Person", "person"), [F.lit(f"{label} BOM Generator").alias("name"), _identified("email", F.lit(GENERATOR_MAIL))]),
        _element("Organization", element_id("Organization", "organization"), [who.alias("name"), _identified("other", whose, F.lit("GitHub").alias("issuingAuthority"), F.array(where).alias("identifierLocator"))]),
        _element("SpdxDocument", element_id("Document", "document"), [profile, F.array(element_id("Bom", "bom")).alias("rootElement")]),
        _element("Bom", element_id("Bom", "bom"), [profile, F.array(package).alias("rootElement")]),
        _element("ai_AIPackage" if ai else "dataset_DatasetPackage", package, (_ai_package if ai else _data_package)(created)),
        _element("simplelicensing_LicenseExpression", license_id, [F.coalesce(_value("license"), F.lit("NOASSERTION")).alias("simplelicensing_licenseExpression"), F.lit(LICENSE_LIST).alias("simplelicensing_licenseListVersion"), F.lit(f"License information extracted from {label} BOM metadata").alias("comment")]),
    ]
    what = "AI package" if ai else "dataset package"
    links = [_edge(element_id("Relationship", f"has{x}License"), f"has{x}License", package, license_id, F.lit(f"{x} license for {what}")) for x in ("Concluded", "Declared")]
    stubs, of_stubs = zip(*(_stubs(*r) for r in RELATIONS)) if ai else ((), ())
    spread = lambda fixed, more: rows.select(F.col("artifact_id").alias("doc_id"), F.posexplode(F.concat(F.array(*fixed), *more)).alias("pos", "e")).select("doc_id", "e.*", "pos")
    return spread(elements, stubs), spread(links, of_stubs)


def rendered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, json): each document's elements and relationships as one graph. Relationships refer to their document's creation
    info, which is the artifact's or, in a bundle, what ``creation_info`` of edges says."""
    info = F.col("creation_info") if "creation_info" in edges.columns else element_id("CreationInfo", "creation")
    told = [F.col("description")] if "description" in edges.columns else []
    edge = F.struct(F.lit("Relationship").alias("type"), F.col("edge_id").alias("spdxId"), info.alias("creationInfo"), F.col("rel_type").alias("relationshipType"), F.col("from_id").alias("from"), F.array("to_id").alias("to"), *told)
    place = lambda df: (F.col("pos") if "pos" in df.columns else F.lit(0)).cast("int").alias("pos")
    all_ = nodes.select("doc_id", F.lit(0).alias("part"), place(nodes), F.col("node_id").alias("id"), "payload")
    all_ = all_.unionByName(edges.withColumn("artifact_id", F.col("doc_id")).select("doc_id", F.lit(1).alias("part"), place(edges), F.col("edge_id").alias("id"), F.to_json(edge).alias("payload")))
    g = all_.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "id", "payload"))).alias("e"))
    return g.select("doc_id", as_graph(F.transform("e", lambda x: x["payload"])).alias("json"))


def as_graph(payloads: Column) -> Column:
    return F.concat(F.lit(f'{{"@context":"{CONTEXT}","@graph":['), F.array_join(payloads, ","), F.lit("]}"))
