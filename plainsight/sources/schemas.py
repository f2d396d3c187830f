"""Declared schemas of the inputs; nothing is inferred."""

REGION = "region STRUCT<startLine INT, startColumn INT, endLine INT, endColumn INT>"
PHYSICAL = f"physicalLocation STRUCT<artifactLocation STRUCT<uri STRING>, {REGION}>"
LOCATION = f"STRUCT<message STRUCT<text STRING>, {PHYSICAL}>"
RESULT = f"""STRUCT<ruleId STRING, ruleIndex INT, message STRUCT<text STRING>,
  locations ARRAY<STRUCT<message STRUCT<text STRING>, {PHYSICAL}, label STRING>>,
  codeFlows ARRAY<STRUCT<label STRING, threadFlows ARRAY<STRUCT<locations ARRAY<STRUCT<location {LOCATION}>>>>>>>"""
RULE = """STRUCT<id STRING, shortDescription STRUCT<text STRING>, fullDescription STRUCT<text STRING>,
  defaultConfiguration STRUCT<level STRING>, properties STRUCT<cwe STRING>>"""
RESULTS = f"runs ARRAY<STRUCT<tool STRUCT<driver STRUCT<rules ARRAY<{RULE}>>>, results ARRAY<{RESULT}>>>"

PARSED_FILE = """STRUCT<variables ARRAY<STRUCT<name STRING, type STRING, methods ARRAY<STRING>>>,
  strings ARRAY<STRUCT<name STRING, methods ARRAY<STRING>>>,
  comments ARRAY<STRUCT<name STRING, methods STRING>>,
  sinks ARRAY<STRUCT<name STRING, methods ARRAY<STRING>>>, methodCodeMap STRING>"""
PARSED_FILES = f"MAP<STRING, {PARSED_FILE}>"

STEP = """STRUCT<step INT, variableName STRING, startLine INT, startColumn INT, endLine INT, endColumn INT,
  uri STRING, type STRING, code STRING, flowIndex INT, vulnerabilityIndex INT>"""
FLOW_MAP = f"""MAP<STRING, ARRAY<STRUCT<resultIndex INT, fileName STRING, flows ARRAY<STRUCT<codeFlowIndex INT,
  flow ARRAY<{STEP}>, label STRING, probability DOUBLE>>>>>"""

FINDINGS = "cwe STRING, path STRING, line INT, col INT"
ADVISORY = """cve_id STRING, summary STRING, severity STRING, published_at STRING, html_url STRING,
  source_code_location STRING, package_name STRING, references ARRAY<STRING>, identifiers ARRAY<STRING>"""
CVE = """cve STRUCT<id STRING, descriptions ARRAY<STRUCT<value STRING>>,
  weaknesses ARRAY<STRUCT<description ARRAY<STRUCT<value STRING>>>>,
  configurations ARRAY<STRUCT<nodes ARRAY<STRUCT<cpeMatch ARRAY<STRUCT<criteria STRING>>>>>>>"""
MODEL_NODE = "STRUCT<name STRING, positive STRING, children MAP<STRING, STRING>, weights MAP<STRING, DOUBLE>, toolName STRING>"
MODEL = f"""STRUCT<factors STRUCT<tqi MAP<STRING, {MODEL_NODE}>, quality_aspects MAP<STRING, {MODEL_NODE}>,
  product_factors MAP<STRING, {MODEL_NODE}>>, measures MAP<STRING, {MODEL_NODE}>, diagnostics MAP<STRING, {MODEL_NODE}>>"""
