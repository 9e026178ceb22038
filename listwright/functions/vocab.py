"""Fixed values the results depend on: vocabularies, type maps, label tables."""

from __future__ import annotations

# Vocabulary bases.
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCT = "http://purl.org/dc/terms/"
OWL = "http://www.w3.org/2002/07/owl#"
SHACL = "http://www.w3.org/ns/shacl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
RDF_LANG_STRING = RDF + "langString"
PREF_LABEL = SKOS + "prefLabel"
IN_SCHEME = SKOS + "inScheme"

# Release metadata.
CREATED = DCT + "created"
MODIFIED = DCT + "modified"
IS_VERSION_OF = DCT + "isVersionOf"
STATUS = "http://www.w3.org/ns/adms#status"
STATUS_BASE = "https://purl.archive.org/adms/status/"

# Subjects in these vocabularies are type definitions, not entries.
EXCLUDED_VOCABULARIES = (XSD, OWL, SKOS, DCT)

# Short names used when an IRI is shown to people.
SHORT_NAMES = (
    ("http://www.w3.org/2001/XMLSchema", "xsd"),
    ("http://www.w3.org/2004/02/skos/core", "skos"),
    ("http://www.w3.org/ns/shacl", "sh"),
    ("http://purl.org/dc/terms", "dct"),
)

# Prefixes that never need declaring.
WELL_KNOWN_PREFIXES = (
    "rdf", "rdfs", "owl",
    "skos", "xkos",
    "dc", "dcterms", "dcmitype",
    "dcat", "qb", "sdmx-attribute", "sdmx-dimension", "sdmx-measure",
    "xsd", "qudt", "qudt-schema", "qudt-unit", "unit",
    "sosa", "ssn", "ssn-system",
    "gml", "gsp", "locn",
    "prov", "foaf", "vcard", "org", "rov", "adms",
    "sh",
    "time",
    "dbo", "schema", "spdx", "void", "ssd",
)

# Constraint components as shown in reports.
CONSTRAINT_LABELS = {
    SHACL + "MinCountConstraintComponent": "minCount (minimum values required)",
    SHACL + "MaxCountConstraintComponent": "maxCount (maximum values allowed)",
    SHACL + "PatternConstraintComponent": "pattern (regex pattern match)",
    SHACL + "NodeConstraintComponent": "node (type constraint)",
    SHACL + "DatatypeConstraintComponent": "datatype (value type)",
    SHACL + "ClassConstraintComponent": "class (RDF class membership)",
    SHACL + "UniqueLangConstraintComponent": "uniqueLang (language uniqueness)",
}

# Declared data type -> rule type.
RULE_TYPES = {
    "xsd:string": "string",
    "xsd:boolean": "boolean",
    "xsd:decimal": "number",
    "xsd:integer": "number",
    "dcterms:temporal": "string",
    "xsd:date": "string",
    "xsd:dateTime": "string",
    "xsd:duration": "string",
}

# Declared data type -> range IRI.
RANGE_TYPES = {
    "xsd:string": XSD + "string",
    "xsd:boolean": XSD + "boolean",
    "xsd:decimal": XSD + "double",
    "xsd:integer": XSD + "integer",
    "xsd:date": XSD + "date",
    "xsd:dateTime": XSD + "dateTime",
    "xsd:duration": XSD + "duration",
}

# Rule type -> range IRI when no data type is declared.
RANGE_BY_RULE_TYPE = {"number": XSD + "double", "boolean": XSD + "boolean", "object": "@id"}

# The observation envelope.
ENVELOPE_REQUIRED = ("resultTime", "observedProperty", "hasFeatureOfInterest", "hasResult")
ENVELOPE_FIELDS = ENVELOPE_REQUIRED + ("wasOriginatedBy",)
RESULT_REQUIRED = ("numericValue", "hasUnit")
ENVELOPE_BY_RELATION = {
    "sosa:hasFeatureOfInterest": "hasFeatureOfInterest",
    "sosa:observedProperty": "observedProperty",
    "sosa:resultTime": "resultTime",
    "sosa:hasResult": "hasResult",
}
FEATURE_RELATION = "sosa:hasFeatureOfInterest"
RESULT_RELATION = "sosa:hasResult"
OBSERVATION_CLASS = "sosa:Observation"

# Vocabulary fragment -> prefix, tried in this order.
RELATION_PREFIXES = (
    ("schema.org/comment", "schema"),
    ("https://schema.org/", "schema"),
    ("http://purl.org/dc/terms/", "dcterms"),
    ("http://purl.org/dc/elements/1.1/", "dc"),
    ("http://www.w3.org/ns/sosa/", "sosa"),
    ("http://www.w3.org/2000/01/rdf-schema#", "rdfs"),
    ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf"),
)

# Reference classes.
PLACEHOLDER_MARKERS = ("TODO",)
UNKNOWN_LABEL = "(onbekend)"
THEME_PATTERN = "thema"

# Unit labels for units no list defines.
UNIT_LABELS = {
    "unit:M3": "m³",
    "unit:M3-PER-YR": "m³/jaar",
    "unit:DAY": "dag",
    "qudt-unit:GigaJ": "GJ",
    "http://TODO": "",
}

# Inverse and sub-property pairs of the SKOS vocabulary.
INVERSE_PAIRS = (
    (SKOS + "topConceptOf", SKOS + "hasTopConcept"),
    (SKOS + "broader", SKOS + "narrower"),
    (DCT + "isPartOf", DCT + "hasPart"),
)
SUBPROPERTY_PAIRS = (
    (SKOS + "broader", SKOS + "broaderTransitive"),
    (SKOS + "broader", SKOS + "semanticRelation"),
    (SKOS + "narrower", SKOS + "narrowerTransitive"),
    (SKOS + "narrower", SKOS + "semanticRelation"),
    (SKOS + "related", SKOS + "semanticRelation"),
    (SKOS + "definition", SKOS + "note"),
)
