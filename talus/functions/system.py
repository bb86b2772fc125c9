"""System functions: constants of this engine, and what isn't kept here."""

from __future__ import annotations

from . import macro

_CONSTANTS = {
    "pg_table_size": "0L", "pg_total_relation_size": "0L", "pg_relation_size": "0L", "pg_table_is_visible": "true", "obj_description": "CAST(NULL AS STRING)", "col_description": "CAST(NULL AS STRING)",
    "shobj_description": "CAST(NULL AS STRING)", "pg_get_viewdef": "''", "pg_get_indexdef": "''", "pg_get_constraintdef": "''", "pg_backend_pid": "1", "pg_postmaster_start_time": "current_timestamp()",
    "inet_server_addr": "'127.0.0.1'", "inet_server_port": "0", "has_table_privilege": "true", "has_schema_privilege": "true", "has_database_privilege": "true", "has_column_privilege": "true",
    "has_function_privilege": "true", "has_sequence_privilege": "true", "pg_advisory_lock": "true", "pg_advisory_xact_lock": "true", "pg_advisory_unlock": "true", "pg_try_advisory_lock": "true",
    "pg_try_advisory_xact_lock": "true",
}
for _name, _value in _CONSTANTS.items():
    macro(_name)(lambda *args, _value=_value: _value)


@macro("pg_get_expr")
def pg_get_expr(x, *rest):
    return f"CAST({x} AS STRING)"


@macro("pg_typeof")
def pg_typeof(x):
    return f"typeof({x})"
