"""Whole documents against SQL, key by key: exports of models and datasets, children of a walk, bundles of rendered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.json_paths import document_paths
from ledgerloom.operators import graph
from ledgerloom.operators.scratch import fresh_path, stored
from ledgerloom.operators.validate import of_documents
from ledgerloom.plans import bundle, cyclonedx, spdx
from ledgerloom.plans.children import child_documents
from ledgerloom.plans.driver_tables import table
from ledgerloom.queries import _query

CREATED = "2024-01-01T00:00:00Z"

#: Fields of every part as a model and as a dataset, each a Spark SQL expression that DuckDB reads alike; null means no field.
MODEL = {
    "suppliedBy": "case when p_partkey % 2 = 0 then 'org' || p_size end",
    "license": "case p_partkey % 3 when 0 then 'MIT' when 1 then 'NOASSERTION' end",
    "primaryPurpose": "case p_partkey % 4 when 0 then 'Model' when 1 then 'odd' end",
    "releaseTime": "case when p_partkey % 5 = 0 then '2024-01-02' when p_partkey % 5 = 1 then 'soon' end",
    "packageVersion": "case when p_partkey % 2 = 1 then '1.' || p_size end",
    "downloadLocation": "case when p_partkey % 3 = 0 then 'https://x.org/' || p_size end",
    "repo_id": "case when p_partkey % 2 = 0 then 'org/m' || p_partkey end",
    "model_name": "case when p_partkey % 7 = 0 then 'n' || p_partkey end",
    "intended_use": "case when p_partkey % 3 = 1 then 'to ' || p_type end",
    "informationAboutApplication": "case when p_partkey % 3 = 2 then 'for ' || p_type end",
    "limitation": "case when p_partkey % 2 = 0 then 'few; short, \"slow\"' end",
    "domain": "case when p_partkey % 2 = 1 then p_brand || '; ' || p_type end",
    "metric": "case when p_partkey % 4 < 2 then 'acc=1; f1=2' end",
    "safetyRiskAssessment": "case p_partkey % 3 when 0 then ' HIGH' when 1 then 'odd' end",
    "autonomyType": "case when p_partkey % 2 = 0 then 'True' end",
    "useSensitivePersonalInformation": "case when p_partkey % 5 = 2 then 'perhaps' end",
    "energyConsumption": "case when p_partkey % 2 = 0 then 'Not found.' else p_size || ' kWh' end",
    "typeOfModel": "case when p_partkey % 3 <> 0 then 'transformer' end",
    "trainedOnDatasets": "case p_partkey % 3 when 0 then 'd1, D1, e' || p_size when 1 then 'Not found' end",
    "modelLineage": "case when p_partkey % 4 = 0 then 'base/m' end",
    "urls.github": "case when p_partkey % 5 = 0 then 'https://github.com/o/r' || p_size end",
}
DATA = {
    "originatedBy": "case when p_partkey % 2 = 0 then 'org' || p_size end",
    "license": "case p_partkey % 3 when 0 then 'CC-BY-4.0' when 1 then 'NOASSERTION' end",
    "builtTime": "case when p_partkey % 5 = 0 then '2023-05-06T07:08:09Z' when p_partkey % 5 = 1 then 'once' end",
    "downloadLocation": "case when p_partkey % 4 = 0 then 'https://x.org/' || p_size end",
    "urls.github": "case when p_partkey % 4 = 1 then 'https://github.com/o/r' || p_size end",
    "urls.huggingface": "case when p_partkey % 4 in (1, 2) then 'https://huggingface.co/datasets/o/r' || p_size end",
    "primaryPurpose": "case p_partkey % 3 when 0 then 'TEST' when 1 then 'odd' end",
    "datasetSize": "case p_partkey % 4 when 0 then p_size || ' KB' when 1 then 'many' end",
    "datasetType": "case p_partkey % 3 when 0 then 'Text; odd, IMAGE' when 1 then 'none' end",
    "datasetAvailability": "case when p_partkey % 2 = 0 then 'Query' end",
    "hasSensitivePersonalInformation": "case p_partkey % 3 when 0 then 'yes' when 1 then 'hardly' end",
    "intendedUse": "case when p_partkey % 2 = 1 then 'to ' || p_type end",
    "knownBias": "case when p_partkey % 3 = 0 then 'some; more' end",
    "dataPreprocessing": "case when p_partkey % 3 = 1 then 'none, really' end",
    "anonymizationMethodUsed": "case when p_partkey % 2 = 0 then 'hash; mask' end",
    "sensorUsed": "case when p_partkey % 2 = 1 then 'camera, lidar' end",
    "dataCollectionProcess": "case when p_partkey % 2 = 0 then 'not found.' else 'crawl' end",
}


def _rows(spark: SparkSession, sf_dir: str, fields: dict[str, str]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.expr(e).alias("value")) for f, e in fields.items()))
    whole = F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))
    key = F.col("p_partkey").cast("string")
    odd = F.when(F.col("p_partkey") % 6 == 0, F.create_map(F.lit("license"), F.concat(F.lit('{"value":"x'), key, F.lit('"}')))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key).alias("artifact_id"), F.col("p_name").alias("name"), whole.alias("fields"), odd.alias("conflicts"))


def _given(fields: dict[str, str], kind: str) -> str:
    package = "AIPackage" if kind == "ai" else "DatasetPackage"
    ids = {"ci": ("CreationInfo", "creation"), "person": ("Person", "person"), "org": ("Organization", "organization"), "doc": ("Document", "document"), "bom": ("Bom", "bom"), "package": (package, "package"), "lic": ("License", "license"), "rc": ("Relationship", "hasConcludedLicense"), "rd": ("Relationship", "hasDeclaredLicense")}
    given = ", ".join(f'{e} as "{f}"' for f, e in fields.items())
    made = ", ".join(f"'urn:spdx:{k}-' || sha1(id || '/{r}') as {n}" for n, (k, r) in ids.items())
    return f"with given as (select 'p' || p_partkey as id, p_partkey as k, p_name as name, p_size, {given} from part), g as (select *, {made} from given)"


_LEAVES = """ select doc_id, element, replace(substr(fullkey, 3), '"', '') as path, atom ->> '$' as value from elements, json_tree(elements.j) where atom is not null and type <> 'NULL'"""
_SPDX = """, elements as (
  select id as doc_id, '' as element, json_object('@context', 'https://spdx.org/rdf/3.0.1/spdx-context.jsonld') as j from g
  union all select id, ci, json_object('type', 'CreationInfo', '@id', ci, 'specVersion', '3.0.1', 'createdBy', json_array(person), 'created', '{created}') from g
  union all select id, person, json_object('type', 'Person', 'spdxId', person, 'creationInfo', ci, 'name', '{label} BOM Generator',
    'externalIdentifier', json_array(json_object('type', 'ExternalIdentifier', 'externalIdentifierType', 'email', 'identifier', 'bom-generator@example.com'))) from g
  union all select id, org, json_object('type', 'Organization', 'spdxId', org, 'creationInfo', ci, 'name', {who},
    'externalIdentifier', json_array(json_object('type', 'ExternalIdentifier', 'externalIdentifierType', 'other', 'issuingAuthority', 'GitHub', 'identifier', {whose}, 'identifierLocator', json_array({where})))) from g
  union all select id, doc, json_object('type', 'SpdxDocument', 'spdxId', doc, 'creationInfo', ci, 'profileConformance', json_array('core', '{profile}'), 'rootElement', json_array(bom)) from g
  union all select id, bom, json_object('type', 'Bom', 'spdxId', bom, 'creationInfo', ci, 'profileConformance', json_array('core', '{profile}'), 'rootElement', json_array(package)) from g
  union all select id, lic, json_object('type', 'simplelicensing_LicenseExpression', 'spdxId', lic, 'creationInfo', ci, 'simplelicensing_licenseExpression', coalesce(license, 'NOASSERTION'),
    'simplelicensing_licenseListVersion', '3.25.0', 'comment', 'License information extracted from {label} BOM metadata') from g
  union all select id, rc, json_object('type', 'Relationship', 'spdxId', rc, 'creationInfo', ci, 'relationshipType', 'hasConcludedLicense', 'from', package, 'to', json_array(lic), 'description', 'Concluded license for {what} package') from g
  union all select id, rd, json_object('type', 'Relationship', 'spdxId', rd, 'creationInfo', ci, 'relationshipType', 'hasDeclaredLicense', 'from', package, 'to', json_array(lic), 'description', 'Declared license for {what} package') from g
  {packages}
)"""
_AI_PACKAGE = """
  union all select id, package, json_object('type', 'ai_AIPackage', 'spdxId', package, 'creationInfo', ci, 'suppliedBy', org, 'originatedBy', json_array(org), 'name', coalesce(model_name, name),
    'releaseTime', case k % 5 when 0 then '2024-01-02T00:00:00Z' when 1 then '{created}' end, 'software_downloadLocation', coalesce(downloadLocation, 'NOASSERTION'), 'software_packageVersion', packageVersion,
    'software_primaryPurpose', 'model', 'ai_informationAboutApplication', coalesce(informationAboutApplication, intended_use), 'ai_limitation', limitation,
    'ai_domain', string_split(domain, '; '), 'ai_typeOfModel', case when typeOfModel is not null then json_array(typeOfModel) end,
    'ai_metric', case when metric is not null then json_array(json_object('type', 'DictionaryEntry', 'key', 'value1', 'value', 'acc=1'), json_object('type', 'DictionaryEntry', 'key', 'value2', 'value', 'f1=2')) end,
    'ai_autonomyType', case when autonomyType is not null then 'yes' end, 'ai_useSensitivePersonalInformation', case when useSensitivePersonalInformation is not null then 'noAssertion' end,
    'ai_safetyRiskAssessment', case when k % 3 = 0 then 'high' end, 'builtTime', '{created}', 'comment', 'This results are generated by AI tools.') from g
  union all select id, 'urn:spdx:DatasetPackage-' || sha1(id || '/trainedOnDatasets/' || lower(t)), json_object('type', 'dataset_DatasetPackage', 'spdxId', 'urn:spdx:DatasetPackage-' || sha1(id || '/trainedOnDatasets/' || lower(t)), 'creationInfo', ci, 'name', t,
    'software_downloadLocation', 'NOASSERTION', 'software_primaryPurpose', 'data', 'dataset_datasetType', json_array('noAssertion')) from named
  union all select id, 'urn:spdx:Relationship-trainedOn-' || sha1(id || '/trainedOnDatasets/' || lower(t)), json_object('type', 'Relationship', 'spdxId', 'urn:spdx:Relationship-trainedOn-' || sha1(id || '/trainedOnDatasets/' || lower(t)), 'creationInfo', ci,
    'relationshipType', 'trainedOn', 'from', package, 'to', json_array('urn:spdx:DatasetPackage-' || sha1(id || '/trainedOnDatasets/' || lower(t))), 'description', 'trainedOn relationship to dataset: ' || t) from named
  union all select id, 'urn:spdx:AIPackage-' || sha1(id || '/modelLineage/base/m'), json_object('type', 'ai_AIPackage', 'spdxId', 'urn:spdx:AIPackage-' || sha1(id || '/modelLineage/base/m'), 'creationInfo', ci, 'name', 'base/m',
    'software_downloadLocation', 'NOASSERTION', 'software_primaryPurpose', 'model') from g where k % 4 = 0
  union all select id, 'urn:spdx:Relationship-dependsOn-' || sha1(id || '/modelLineage/base/m'), json_object('type', 'Relationship', 'spdxId', 'urn:spdx:Relationship-dependsOn-' || sha1(id || '/modelLineage/base/m'), 'creationInfo', ci,
    'relationshipType', 'dependsOn', 'from', package, 'to', json_array('urn:spdx:AIPackage-' || sha1(id || '/modelLineage/base/m')), 'description', 'dependsOn relationship to model: base/m') from g where k % 4 = 0"""
_DATA_PACKAGE = """
  union all select id, package, json_object('type', 'dataset_DatasetPackage', 'spdxId', package, 'creationInfo', ci, 'originatedBy', json_array(org), 'name', name,
    'builtTime', case when k % 5 = 0 then builtTime else '{created}' end, 'releaseTime', '{created}', 'software_downloadLocation', {where}, 'software_primaryPurpose', case when k % 3 = 0 then 'test' else 'data' end,
    'dataset_dataCollectionProcess', dataCollectionProcess, 'dataset_datasetNoise', '', 'dataset_datasetUpdateMechanism', '', 'dataset_intendedUse', coalesce(intendedUse, ''),
    'dataset_dataPreprocessing', case when dataPreprocessing is not null then json_array(dataPreprocessing) end, 'dataset_knownBias', case when knownBias is not null then json_array(knownBias) end,
    'dataset_anonymizationMethodUsed', case when k % 2 = 0 then json_array('hash', 'mask') end,
    'dataset_sensor', case when k % 2 = 1 then json_array(json_object('type', 'DictionaryEntry', 'key', 'value1', 'value', 'camera'), json_object('type', 'DictionaryEntry', 'key', 'value2', 'value', 'lidar')) end,
    'dataset_datasetType', case k % 3 when 0 then json_array('text', 'other', 'image') when 1 then json_array('noAssertion') else json_array('other') end,
    'dataset_datasetAvailability', case when k % 2 = 0 then 'query' else 'directDownload' end, 'dataset_confidentialityLevel', 'clear',
    'dataset_hasSensitivePersonalInformation', case when k % 3 = 0 then 'yes' else 'no' end, 'dataset_datasetSize', case when k % 4 = 0 then p_size * 1000 end, 'comment', 'Generated automatically.') from g"""


def _spdx_sql(kind: str) -> str:
    if kind == "ai":
        names = ", named as (select id, ci, package, unnest(['d1', 'e' || p_size]) as t from g where k % 3 = 0)"
        parts = {"label": "AI", "profile": "ai", "what": "AI", "who": "coalesce(suppliedBy, 'Unknown')", "whose": "coalesce(repo_id, id)", "where": "'NOASSERTION'"}
        return _given(MODEL, kind) + names + _SPDX.format(**parts, created=CREATED, packages=_AI_PACKAGE.format(created=CREATED)) + _LEAVES
    who, where = "coalesce(originatedBy, 'Unknown')", """coalesce(downloadLocation, "urls.github", "urls.huggingface", 'NOASSERTION')"""
    parts = {"label": "Dataset", "profile": "dataset", "what": "dataset", "who": who, "whose": who, "where": where}
    return _given(DATA, kind) + _SPDX.format(**parts, created=CREATED, packages=_DATA_PACKAGE.format(created=CREATED, where=where)) + _LEAVES


@_query(_spdx_sql("ai"))
def spdx_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key and value of the SPDX documents of all parts as models."""
    return document_paths(spdx.rendered(*spdx.documents(_rows(spark, sf_dir, MODEL), "ai", F.lit(CREATED))))


@_query(_spdx_sql("data"))
def spdx_golden_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all parts as datasets."""
    return document_paths(spdx.rendered(*spdx.documents(_rows(spark, sf_dir, DATA), "data", F.lit(CREATED))))


_CYCLONEDX = """, serials as (select *, sha1(id || '/cyclonedx') as h from g), elements as (select id as doc_id, '' as element, json_object('bomFormat', 'CycloneDX', 'specVersion', '1.7', 'version', 1,
  'serialNumber', 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32], 'metadata', json_object('timestamp', '{created}',
  'tools', json_array(json_object('name', 'ledgerloom', 'version', '1.0.0')), 'authors', json_array(json_object('name', 'BOM Generator'))), 'components', json_array({component})) as j from serials)"""
_AI_COMPONENT = """json_object('type', 'machine-learning-model', 'bom-ref', 'ai-model:' || id, 'name', coalesce(model_name, name), 'version', packageVersion, 'description', coalesce(informationAboutApplication, intended_use, ''),
  'supplier', case when suppliedBy is not null then json_object('name', suppliedBy) end, 'licenses', case when license = 'MIT' then json_array(json_object('license', json_object('id', 'MIT'))) end,
  'externalReferences', list_filter([case when repo_id is not null then json_object('type', 'documentation', 'url', 'https://huggingface.co/' || repo_id) end, case when "urls.github" is not null then json_object('type', 'vcs', 'url', "urls.github") end], lambda x: x is not null),
  'modelCard', json_object('modelParameters', json_object('task', primaryPurpose, 'architectureFamily', typeOfModel,
      'datasets', case when k % 3 = 0 then json_array(json_object('type', 'training', 'name', 'd1'), json_object('type', 'training', 'name', 'D1'), json_object('type', 'training', 'name', 'e' || p_size)) end),
    'quantitativeAnalysis', case when metric is not null then json_object('performanceMetrics', json_array(json_object('type', 'other', 'value', metric))) end,
    'considerations', json_object('technicalLimitations', case when limitation is not null then json_array(limitation) end,
      'ethicalConsiderations', case when safetyRiskAssessment is not null then json_array(json_object('name', 'safetyRiskAssessment', 'description', safetyRiskAssessment)) end)),
  'pedigree', case when k % 4 = 0 then json_object('ancestors', json_array(json_object('type', 'machine-learning-model', 'name', 'base/m'))) end,
  'properties', list_filter([case when k % 2 = 1 then json_object('name', 'bom:energyConsumption', 'value', energyConsumption) end, case when autonomyType is not null then json_object('name', 'bom:autonomyType', 'value', autonomyType) end,
    case when useSensitivePersonalInformation is not null then json_object('name', 'bom:useSensitivePersonalInformation', 'value', 'perhaps') end, case when k % 6 = 0 then json_object('name', 'bom:conflict:license', 'value', '{{"value":"x' || k || '"}}') end], lambda x: x is not null))"""
_DATA_COMPONENT = """json_object('type', 'data', 'bom-ref', 'dataset:' || id, 'name', name, 'description', coalesce(intendedUse, ''), 'supplier', case when originatedBy is not null then json_object('name', originatedBy) end,
  'licenses', case when k % 3 = 0 then json_array(json_object('license', json_object('id', 'CC-BY-4.0'))) end,
  'properties', list_filter([case when datasetSize is not null then json_object('name', 'bom:datasetSize', 'value', datasetSize) end, case when datasetType is not null then json_object('name', 'bom:datasetType', 'value', datasetType) end,
    case when k % 2 = 1 then json_object('name', 'bom:dataCollectionProcess', 'value', 'crawl') end, case when knownBias is not null then json_object('name', 'bom:knownBias', 'value', knownBias) end,
    case when hasSensitivePersonalInformation is not null then json_object('name', 'bom:hasSensitivePersonalInformation', 'value', hasSensitivePersonalInformation) end,
    case when anonymizationMethodUsed is not null then json_object('name', 'bom:anonymizationMethodUsed', 'value', anonymizationMethodUsed) end], lambda x: x is not null))"""


@_query(_given(MODEL, "ai") + _CYCLONEDX.format(created=CREATED, component=_AI_COMPONENT.format()) + _LEAVES)
def cyclonedx_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key and value of the CycloneDX documents of all parts as models."""
    return document_paths(cyclonedx.documents(_rows(spark, sf_dir, MODEL), "ai", F.lit(CREATED)))


@_query(_given(DATA, "data") + _CYCLONEDX.format(created=CREATED, component=_DATA_COMPONENT) + _LEAVES)
def cyclonedx_golden_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all parts as datasets."""
    return document_paths(cyclonedx.documents(_rows(spark, sf_dir, DATA), "data", F.lit(CREATED)))


@_query("""
with n as (select p_partkey as k, case when p_partkey % 10 = 9 then 'other' when p_partkey % 2 = 0 then 'ai' else 'data' end as kind, case when p_partkey % 3 = 0 then 'Org/t' else 't ' end || p_partkey as target,
  p_partkey % 4 = 0 and p_partkey % 7 <> 0 as enriched, p_partkey % 7 = 0 as failed, p_partkey % 4 = 0 and p_partkey % 7 <> 0 and p_partkey % 12 = 0 as twice from part), e as (
  select *, case when kind = 'other' then 'invalid kind: other' when twice then 'repeated field: license' end as error from n)
select k as seq, kind, target, enriched, case when failed then 'timeout of ' || k end as enrichment_error, error as spdx_error, error as cyclonedx_error, case when error is null then true end as valid,
  case when error is null then case when enriched then 'MIT' else 'NOASSERTION' end end as license, case when error is null then target end as name,
  case when error is null then case when kind = 'data' then 'Referenced by m' || k % 5 || ' via trainedOn' else '' end end as description,
  case when error is null and kind = 'data' then case when k % 3 = 0 then 'https://huggingface.co/datasets/' || target else 'NOASSERTION' end end as location from e""")
def recursive_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a node of a walk: two kinds and a broken one, enriched, failed and seeded ones, and metadata that repeats a field."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind = F.when(k % 10 == 9, "other").when(k % 2 == 0, "ai").otherwise("data")
    target = F.concat(F.when(k % 3 == 0, "Org/t").otherwise("t "), key)
    relation = F.when(k % 2 == 0, "dependsOn").otherwise("trainedOn")
    nodes = table(spark, sf_dir, "part").select(k.alias("seq"), F.lit(1).alias("depth"), relation.alias("relation"), F.lit("f").alias("field"), target.alias("target"), kind.alias("kind"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("parent"))
    entry = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"))
    some = F.concat(F.array(entry("license", "MIT")), F.when(F.col("seq") % 12 == 0, F.array(entry("license", "GPL-3.0"))).otherwise(F.array().cast("array<struct<field:string,value:string>>")))
    error = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("timeout of "), F.col("seq").cast("string")))
    enriched = nodes.where("seq % 4 = 0 or seq % 7 = 0").select("kind", F.upper("target").alias("target"), F.when(error.isNull(), some).alias("metadata"), error.alias("error"))
    out = child_documents(nodes, F.lit(CREATED), enriched)
    of_spdx, of_cyclonedx = (lambda p: F.get_json_object("spdx", p)), (lambda p: F.get_json_object("cyclonedx", f"$.components[0].{p}"))
    location = F.when(F.col("kind") == "data", of_spdx("$.@graph[5].software_downloadLocation"))
    return out.select("seq", "kind", "target", "enriched", "enrichment_error", "spdx_error", "cyclonedx_error", "valid", of_spdx("$.@graph[6].simplelicensing_licenseExpression").alias("license"), of_cyclonedx("name").alias("name"), of_cyclonedx("description").alias("description"), location.alias("location"))


@_query("""
with s as (select 's' || s_suppkey as id, s_suppkey as k, 'urn:spdx:AIPackage-' || sha1('s' || s_suppkey || '/package') as root, 'urn:spdx:AIPackage-' || sha1('ai:b' || s_suppkey || '/package') as base,
  'urn:spdx:DatasetPackage-' || sha1('data:d' || s_suppkey || '/package') as d, 'urn:spdx:DatasetPackage-' || sha1('data:g' || s_suppkey || '/package') as g from supplier)
select id as bundle_id, cast(30 as bigint) as node_count, cast(3 as bigint) as recursive_edge_count, true as valid, 's' || k || '|s' || k || '|s' || k || '|s' || k as organisations,
  'urn:spdx:Relationship-trainedOn-d' || k || '-d1 ' || root || ' ' || d || '|urn:spdx:Relationship-dependsOn-B' || k || '-d1 ' || root || ' ' || base || '|urn:spdx:Relationship-trainedOn-g' || k || '-d2 ' || base || ' ' || g as edges,
  'e' || k || '|g' || k as stubs from s""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each supplier: a model with two datasets and a base model, whose own dataset is the second level; all are rendered
    documents. What is left of them: elements, edges of the walk, validation, whom the packages come from, stubs."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("s"), k).alias("bundle_id"))
    text = lambda *parts: F.concat(*(F.lit(p) if not p.startswith("$") else F.col(p[1:]) for p in parts))
    fields = F.create_map(F.lit("suppliedBy"), F.col("bundle_id"), F.lit("trainedOnDatasets"), text("D", "$k", ", e", "$k"), F.lit("modelLineage"), text("B", "$k"))
    rows = s.select(F.col("bundle_id").alias("artifact_id"), F.col("bundle_id").alias("name"), fields.alias("fields"))
    parents = spdx.rendered(*spdx.documents(rows, "ai", F.lit(CREATED))).select(F.col("doc_id").alias("bundle_id"), F.lit("ai").alias("kind"), F.col("doc_id").alias("name"), "json")
    node = lambda seq, depth, relation, kind, target, parent: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(depth).alias("depth"), F.lit(relation).alias("relation"), F.lit("f").alias("field"), text(target, "$k").alias("target"), F.lit(kind).alias("kind"), text(*parent).alias("parent"))
    three = F.array(node(1, 1, "trainedOn", "data", "d", ("$bundle_id",)), node(2, 1, "dependsOn", "ai", "B", ("$bundle_id",)), node(3, 2, "trainedOn", "data", "g", ("b", "$k")))
    walked = s.select("bundle_id", F.explode(three).alias("n")).select("bundle_id", "n.*")
    told = F.array(F.struct(F.lit("trainedOnDatasets").alias("field"), text("g", "$k").alias("value")), F.struct(F.lit("suppliedBy").alias("field"), F.lit("other").alias("value")))
    enriched = s.select(F.lit("ai").alias("kind"), text("b", "$k").alias("target"), told.alias("metadata"), F.lit(None).cast("string").alias("error"))
    documents = child_documents(walked.drop("bundle_id"), F.lit(CREATED), enriched).select("kind", "target", F.col("spdx").alias("json"))
    linked = stored(bundle.link_documents(parents, walked.join(documents, ["kind", "target"], "left")), fresh_path(spark, "linked"))

    parts = F.transform(F.try_variant_get(F.parse_json("json"), "$['@graph']", "array<variant>"), lambda e: F.struct(*(F.try_variant_get(e, f"$.{p}", t).alias(a) for p, a, t in (("type", "type", "string"), ("spdxId", "id", "string"), ("name", "name", "string"), ("from", "source", "string"), ("to", "to", "array<string>"), ("originatedBy", "by", "array<string>")))))
    linked = linked.withColumn("parts", parts)
    organisation = F.element_at(F.filter("parts", lambda e: e["type"] == "Organization"), 1)
    whose = F.transform(F.filter("parts", lambda e: e["by"].isNotNull()), lambda e: F.when(e["by"] == F.array(organisation["id"]), organisation["name"]).otherwise("?"))
    edges = F.transform(F.filter("parts", lambda e: e["id"].rlike(r"-d\d+$")), lambda e: F.concat_ws(" ", e["id"], e["source"], e["to"][0]))
    stubs = F.transform(F.filter("parts", lambda e: (e["type"] == "dataset_DatasetPackage") & e["by"].isNull()), lambda e: e["name"])
    valid = of_documents(linked.select(F.col("bundle_id").alias("doc_id"), F.lit("ai").alias("kind"), "json"), strict=True).select(F.col("doc_id").alias("bundle_id"), "valid")
    return linked.join(valid, "bundle_id").select("bundle_id", "node_count", "recursive_edge_count", "valid", *(F.array_join(a, "|").alias(n) for a, n in ((whose, "organisations"), (edges, "edges"), (stubs, "stubs"))))
