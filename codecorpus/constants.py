"""Fixed values that must equal the reference's byte for byte.

Markers, sentinels, error kinds, prompt literals and regex patterns are kept
together here, in natural order, so every module uses the same text.
"""

# --- fixed values: markers in masked code -----------------------------------
FILL_FUNCTION_BODY = "<FILL_FUNCTION_BODY>"
FILL_FUNCTION = "<FILL_FUNCTION>"
BODY_PLACEHOLDER = "{<BODY>}"

# --- fixed values: status sentinels -------------------------------------------
COMPILED_SUCCESSFULLY = "<COMPILED_SUCCESSFULLY>"
SUCCESS = "<success>"
EXECUTE_ERROR = "<execute_error>"
PARSER_ERROR = "<PARSER_ERROR>"
NO_PARAM_CLASS = "<no_param_class>"
NOT_SELF_DEFINED_CLASS = "<not_self_defined_class>"
CONTEXT_ERROR = "<error>"
PARAM_CLASS = "<param_class>"

# --- fixed values: tool output texts ------------------------------------------
SOLIDITY_SUCCESS_TEXT = "Compiled 1 Solidity file successfully"
JUNIT_FAILURES_TEXT = "FAILURES!!!"

# --- fixed values: Solidity compiler error kinds, in the reference's order ---
SOLIDITY_ERROR_KINDS = (
    "ParserError",
    "DocstringParsingError",
    "SyntaxError",
    "DeclarationError",
    "TypeError",
    "UnimplementedFeatureError",
    "InternalCompilerError",
    "Exception",
    "CompilerError",
)

# --- fixed values: fill-in-the-middle and instruction prompts ----------------
FIM_BEGIN = "<｜fim▁begin｜>"
FIM_HOLE = "<｜fim▁hole｜>"
FIM_END = "<｜fim▁end｜>"
EOT = "<|EOT|>"
IGNORE_INDEX = -100
# prefix/suffix/middle style markers and end marker
PSM_PRE = "▁<PRE>"
PSM_SUF = "▁<SUF>"
PSM_MID = "▁<MID>"
PSM_EOT = "▁<EOT>"
# task-conditional source literals (misspelling "ouput" is part of the format)
LIT_OUTPUT = "\n<ouput>\n"
LIT_COMPILE = "\n<compile>\n"
LIT_INHERIT = "\n<inherit>\n"
LIT_CORRECT = "\n<correct> "
LIT_CORRECT_PSM = "\n<correct>"
INSTRUCTION_HEAD = (
    "You are an AI programming assistant, utilizing the DeepSeek Coder model, "
    "developed by DeepSeek Company, and you only answer questions related to "
    "computer science. For politically sensitive questions, security and privacy "
    "issues, and other non-computer science questions, you will refuse to answer.\n"
    "### Instruction:\n"
)
INSTRUCTION_TAIL = "\n### Response:\n"

# --- fixed values: regex patterns (Java regex syntax) -------------------------
# comments: line comment (swallowing a final newline at end of text), block
# comment, or an unterminated block comment which is kept (group 1).
RE_COMMENTS = r"//[^\n]*\n?\z|//[^\n]*|/\*[\s\S]*?\*/|(/\*[\s\S]*)\z"
RE_PRIVATE = r"(?<=\s)private\s"
RE_MAVEN_ERROR = r"^\[ERROR\] (.+?):\[(\d+),(\d+)\] (.+)$"
RE_FEEDBACK = r"<file>(.*?)<line>(\d+)<col>(\d+)<err>(.*)"
RE_FAILED_TEST = r"^\d+\) (test\d+)\(RegressionTest\d+\)$"
RE_SKIPPED_TYPE = (
    r"^(String|int|byte|short|long|float|double|boolean|char|Object|Integer|Long|"
    r"Double|Boolean|Character|CharSequence|Byte|Float|Short)"
)
RE_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
RE_STAGE_DONE = r"^(\d+)\) .*done$"

# --- fixed values: limits from the reference ---------------------------------
MAX_TOKENS = 2048
MODEL_MAX_LENGTH = 512
TEST_STAGES = 13
# random seeds used by the reference's samplers
SEED_CAPPED = 0
SEED_WEIGHTED = 11
SEED_GENERATOR = 42
# fixed addresses for the random-input generator, in the reference's order
ADDRESSES = (
    "0xca35b7d915458ef540ade6068dfe2f44e8fa733c",
    "0x14723a09acff6d2a60dcdf7aa4aff308fddc160c",
    "0x4b0897b0513fdc7c541b6d9d7e929c4e5364d2db",
    "0x583031d1113ad414f02576bd6afabfb302140225",
    "0xdd870fa1b7c4700f2bd7f44238821c26f7392148",
)
# printable characters used for random strings: code points 32..126, length 10
STRING_LEN = 10
