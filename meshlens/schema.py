"""Data model: node, edge and side-table schemas (as DDL), and the small dimension tables of kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 4
VIRTUAL_REPO = "__virtual__"

SPAN = "struct<line_start:int,line_len:int,column_start:int,column_len:int>"
NODES = f"id string, kind string, repo string, file_path string, name string, qualified_name string, external_id string, signature string, visibility string, span {SPAN}, is_virtual boolean, ai_role string"
EDGES = "source string, target string, kind string, owner_file string, is_cross_file boolean, weight int, confidence int, timestamp_unix bigint, drift_kind string, resolver string, guard_has_default boolean, enum_qn string, access_mechanism string"
COMMITS = "repo string, sha string, author_email string, date bigint, message string, classification string, files_changed int, insertions int, deletions int, has_decision_signal boolean, pr_number int"
DELTAS = "repo string, sha string, file_path string, change_kind string, insertions int, deletions int, old_path string"
CONTRACTS = "id string, target_id string, target_kind string, target_qn string, repo string, file_path string, source_symbol_id string, line_start int, side string, confidence int, inference_kind string, source_type_name string, fields array<struct<name:string,type_name:string,optional:boolean,confidence:int>>"
FILE_STATE = "repo string, file_path string, content_hash string, size_bytes bigint, mtime_ns bigint, node_count int, edge_count int, indexed_at bigint, parse_ms bigint"

# Node kinds in code order.
NODE_KINDS = (
    "file function class type module import decorator entity route topic queue subject stream event shared_symbol payload_contract repo convention service "
    "commit pr review comment author ticket data_field deployment env_var secret config_map workflow_job broker database agent_graph prompt ai_contract "
    "vector_index mcp_server mcp_tool llm_model value_mirror"
).split()
# Node kinds that search does not index.
NOT_INDEXED = frozenset("import decorator commit pr review comment author ticket secret".split())
# Virtual node kinds whose repository is rewritten.
CONVERGENCE_KINDS = "route topic queue subject stream event shared_symbol repo service llm_model prompt vector_index mcp_server mcp_tool".split()

# Edge kinds as (first code of a range, kinds from it on).
EDGE_RANGES = (
    (0, "defines calls imports exports extends implements references depends_on uses_decorator"),
    (20, "publishes consumes triggers serves persists_to uses_shared uses_type_from uses_event_from uses_guard_from consumes_api_from produces_event_for implements_contract_from consumes_hook_from"),
    (40, "changed_in introduced_by authored_by reviewed_by merged_as commented_on"),
    (60, "resolves relates_to part_of"),
    (80, "breaks_if_changed co_changes_with owned_by cross_repo_depends propagates_event drifts_from contract_on migrates_collection mirrors_value_from guards_enum_value"),
    (90, "reads_field writes_field derives_field_from filters_on_field indexes_field backfills_field"),
    (100, "deployed_as reads_env backed_by built_by uses_broker uses_database"),
    (110, "defines_agent_node graph_transitions_to composes_agent spawns_subagent binds_tool invokes_llm produces_ai_contract uses_prompt fetches_prompt_from retrieves_from embeds indexes_vector calls_mcp_tool exposes_mcp_tool"),
)
EDGE_KINDS = {k: first + i for first, names in EDGE_RANGES for i, k in enumerate(names.split())}

# Edge kinds that bridge repositories in meaning.
SEMANTIC_BRIDGES = frozenset(
    "serves consumes consumes_api_from publishes uses_event_from produces_event_for references implements uses_shared uses_type_from uses_guard_from "
    "implements_contract_from contract_on drifts_from propagates_event consumes_hook_from deployed_as reads_env backed_by built_by uses_broker uses_database "
    "fetches_prompt_from embeds calls_mcp_tool retrieves_from".split()
)
# Access mechanisms; kinds not named are "other".
ACCESS = {
    "direct_call": "calls uses_decorator references triggers defines_agent_node graph_transitions_to composes_agent spawns_subagent binds_tool invokes_llm produces_ai_contract calls_mcp_tool exposes_mcp_tool",
    "http_route": "serves consumes_api_from",
    "event": "publishes consumes uses_event_from produces_event_for propagates_event uses_broker",
    "env_var": "reads_env",
    "config": "uses_prompt fetches_prompt_from",
    "shared_type": "uses_shared uses_type_from uses_guard_from implements_contract_from consumes_hook_from contract_on drifts_from mirrors_value_from guards_enum_value",
}
# Weights of call-resolution strategies.
RESOLVERS = {
    "import_map": 100, "same_module": 90, "frontend_constant": 80, "field_direct": 80, "unique": 70, "frontend_literal": 65, "frontend_hint": 60, "field_local_alias": 55,
    "history_ownership": 50, "value_mirror": 50, "co_change": 45, "suffix": 40, "fuzzy_name": 30, "first-pass": 25, "second-pass": 20, "fallback": 10,
}
# Strengths of planning proofs.
PROOF_STRENGTH = {
    "direct_call": 85, "event_producer_consumer": 80, "guard_usage": 80, "shared_contract_consumer": 75, "projection_field_evidence": 72, "route_client_server": 70,
    "import_bridge": 55, "co_change_advisory": 25,
}
# How specific an edge is as evidence of impact (others 1), and within an evidence chain (others 0).
IMPACT_SPECIFICITY = {"implements_contract_from": 6, "produces_event_for": 5, "uses_type_from": 4, "consumes_api_from": 3, "uses_event_from": 3, "uses_guard_from": 3, "contract_on": 2, "uses_shared": 2, "references": 2}
CHAIN_SPECIFICITY = {"implements_contract_from": 7, "uses_type_from": 6, "consumes_api_from": 5, "uses_event_from": 4, "calls": 3, "references": 2, "imports": 1}


def access_mechanism(kind: str) -> str:
    return next((a for a, kinds in ACCESS.items() if kind in kinds.split()), "other")


def node_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, k not in NOT_INDEXED) for i, k in enumerate(NODE_KINDS)], "code int, kind string, search_indexable boolean")


def edge_kinds(spark: SparkSession) -> DataFrame:
    rows = [(c, k, access_mechanism(k), k in SEMANTIC_BRIDGES, k not in ("defines", "imports"), IMPACT_SPECIFICITY.get(k, 1), CHAIN_SPECIFICITY.get(k, 0)) for k, c in EDGE_KINDS.items()]
    return spark.createDataFrame(rows, "code int, kind string, access_mechanism string, is_bridge boolean, is_consumer boolean, impact_specificity int, chain_specificity int")


def resolvers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESOLVERS.items()), "resolver string, weight int")


def assert_version(found: int) -> None:
    """Stored tables of another schema version are refused, not guessed at."""
    if found != SCHEMA_VERSION:
        raise ValueError(f"schema version {found}; this engine reads {SCHEMA_VERSION}")
