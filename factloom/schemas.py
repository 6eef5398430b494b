"""The relations of a program's facts. Identifiers (``vid``) are integers; "not found" is no row, never -1."""

VALUE = "vid int, kind string, func_vid int, ord int, name string, demangled string, is_ptr boolean, is_decl boolean, is_intrinsic boolean, opcode string"
NAME_INDEX = "name string, vid int, is_real boolean"
STRUCT_TYPE = "vid int, name string"
DEBUG_LOC = "vid int, path string, line_start int, line_end int"
USE = "def_vid int, user_vid int, operand_no int"
CALL_SITE = "callsite int, caller int, kind string, operand int"
CALL_EDGE = "type string, caller int, callsite int, callee int"
CG_PATCH = "seq bigint, caller_name string, callee_name string"
CONSTRAINT = "op string, dst int, src int"
PTS = "ptr int, site int"
PTS_STATUS = "ptr int, known boolean"
ALLOC_SITE = "type string, vid int, func_vid int, ord int"
MEM_FN = "symbol string, fn_group string, is_alloc boolean, is_free boolean, size_rule string"
TRACE = "seq bigint, stream_id bigint, vid int, action smallint, ptr decimal(20,0), size decimal(20,0)"
NOTE = "path string, heading string, ord int, text string"

#: Action codes of a trace, fixed values.
ALLOCA, HEAP_ALLOCA, HEAP_FREE, REGION, PROBE, BEGIN_SCOPE, END_SCOPE, LANDING = 0, 1, 2, 3, 8, 16, 17, 18
