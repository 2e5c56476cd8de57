"""Patterns, term sets, rule scores, weights and thresholds that results depend on.

Patterns are in the dialect that Java and RE2 share, but for three that need a lookahead in Java; those have a twin that
matches the same texts without one (TWIN).
"""

# --- fixed values: patterns over source code ---------------------------------------------------------------------
PATTERN = {
    "cred_env": r"process\.env\s*[\[.]\s*['\"]?(AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|GITHUB_TOKEN|NPM_TOKEN|SSH_KEY|SSH_PRIVATE_KEY|GH_TOKEN|GITLAB_TOKEN|NPM_AUTH_TOKEN|HEROKU_API_KEY|SLACK_TOKEN|DISCORD_TOKEN)",
    "net_send": r"(?i)(https?\.request|https?\.get|https?\.post|fetch\s*\(|axios\.|XMLHttpRequest|net\.Socket|node-fetch|got\s*\(|superagent|\.request\s*\()",
    "sensitive_files": r"(/etc/passwd|/etc/shadow|~/\.ssh|\.ssh/|id_rsa|\.aws/credentials|~/\.npmrc|\.npmrc|\.bash_history|\.gitconfig|\.gnupg)",
    "file_read": r"(?i)(readFileSync|readFile\s*\(|createReadStream|readdirSync|readdir\s*\()",
    "child_proc": r"(child_process|\.exec\s*\(|\.execSync\s*\(|\.spawn\s*\(|\.spawnSync\s*\()",
    "shell_cmd": r"(?i)(curl |wget |powershell|bash |/bin/sh|/bin/bash|cmd\s*/c|\|\s*(?:sh|bash)\b)",
    "node_e_loader": r"(?i)node\s+-[ep]\b(?=.*(?:Buffer\.from|atob|eval|Function|http|https|curl|wget|base64))",
    "dns_exfil": r"(dns\.lookup|dns\.resolve|dgram\.createSocket|dgram\.Socket)",
    "rs_socket": r"(net\.Socket|net\.createConnection|net\.connect|new\s+Socket|dgram\.createSocket|\bnet\b)",
    "rs_shell": r"(child_process|/bin/sh|/bin/bash|cmd\.exe|powershell|\bspawn\b)",
    "rs_pipe": r"\.pipe\s*\(",
    "hex_esc": r"\\x[0-9a-fA-F]{2}",
    "uni_esc": r"\\u[0-9a-fA-F]{4}",
    "from_char_code": r"(?i)String\.fromCharCode",
    "b64_long": r"['\"`]([A-Za-z0-9+/=]{100,})['\"`]",
    "eval": r"(\beval\s*\(|\bFunction\s*\(|new\s+Function|vm\.runInNewContext)",
    "b64_decode": r"(Buffer\.from\s*\([^)]*['\"]base64['\"]|atob\s*\(|from\s*\([^)]*,\s*['\"]base64['\"])",
    "env_bulk": r"(Object\.keys\s*\(\s*process\.env\s*\)|Object\.entries\s*\(\s*process\.env\s*\)|JSON\.stringify\s*\(\s*process\.env\s*\)|\{\s*\.\.\.process\.env\s*\})",
    "webhook": r"(?i)(webhook\.site|requestbin\.com|pipedream\.com|hookbin\.com|burpcollaborator\.net|interact\.sh|oastify\.com|ngrok\.io|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})",
    "local_require": r"require\s*\(\s*['\"](\./[^'\"]+)['\"]\s*\)",
    "localhost": r"(localhost|127\.0\.0\.1|0\.0\.0\.0|registry\.npmjs\.org|npmjs\.org)",
    "dyn_require": r"\brequire\s*\((?!\s*['\"])",
    "dyn_sink": r"(\beval\s*\(|\bFunction\s*\(|\brequire\s*\()",
    "b64_40": r"['\"`]([A-Za-z0-9+/=]{40,})['\"`]",
    "hex10": r"(?:\\x[0-9a-fA-F]{2}){10,}",
    "decode": r"\b(?:Buffer\.from|atob|decodeURIComponent|String\.fromCharCode)\s*\(",
    "exec_sink": r"(?:\beval\s*\(|\bFunction\s*\(|\brequire\s*\(|https?\.\s*(?:get|post|request)\s*\(|\bfetch\s*\(|\baxios\b)",
    "dns_usage": r"\b(?:dns\.lookup|dns\.resolve[A-Za-z]*|dgram\.createSocket|dgram)\b",
    "exfil_source": r"(?:process\.env|os\.hostname|os\.userInfo|os\.platform|readFileSync|readFile\s*\()",
    "proto_pollution": r"(?:__proto__|constructor\s*\.\s*prototype|Object\.defineProperty\s*\([^)]*prototype)",
    "module_exports": r"module\.exports",
    "self_delete": r"(?i)(?:fs\.)?(?:unlinkSync|unlink|rmSync|rm)\s*\(\s*(?:__filename|process\.argv\s*\[\s*1\s*\])",
    # over lifecycle commands of a manifest
    "m_curl_pipe": r"(?i)\b(?:curl|wget)\b[^|]{1,500}\|\s*(?:sh|bash|node|python)\b",
    "m_node_double": r"(?i)\bnode\s+-[ep]\b\s*\"(.*?)\"",
    "m_node_single": r"(?i)\bnode\s+-[ep]\b\s*'(.*?)'",
    "m_node_bare": r"(?i)\bnode\s+-[ep]\b\s*([^;&|]+)",
    "m_node_susp": r"(?i)(require\s*\(|Buffer\b|https?\b|eval\s*\(|Function\b|atob\b|base64)",
    "m_b64_token": r"\b[A-Za-z0-9+/]{40,}={0,2}\b",
    "m_decode": r"(?i)(Buffer\.from\s*\([^)]*base64|atob\s*\(|base64\s+-d|from\s*\([^)]*,\s*[\"']base64[\"']|decodeURIComponent\s*\()",
    "m_url": r"(?i)https?://[^\s\"'`<>\\]+",
    "m_benign": r"(?i)^\s*(?:husky\s+install|patch-package)\s*$",
    # of code that nodes of a syntax tree hold
    "taint_decode": r"(?s)Buffer\.from\b.*?base64",
    "taint_atob": r"\batob\s*\(",
    "taint_read": r"\breadFileSync\s*\(",
    "taint_env": r"process\.env\b",
    "sink": r"(?:\beval\s*\(|\bFunction\s*\(|\b(?:exec|execSync)\s*\(|\b(?:spawn|spawnSync)\s*\(|\bhttps?\s*\.\s*(?:request|get)\s*\(|\bfetch\s*\(|\bwriteFileSync\s*\(|\bSocket\s*\(|\bdns\s*\.\s*lookup\s*\()",
    # of the text of one node
    "n_eval": r"\b(eval|Function)\s*\(",
    "n_exec": r"\b(exec|execSync|spawn|spawnSync)\s*\(",
    "n_network": r"\bhttps?\s*\.\s*(?:get|post|request)\s*\(|\bfetch\s*\(|\baxios\s*\.\s*(?:get|post|request|put|delete)\s*\(|\bSocket\s*\(|\bdns\s*\.\s*lookup\s*\(",
    "n_file": r"\b(?:readFileSync|writeFileSync|readFile|writeFile|createReadStream|createWriteStream)\s*\(",
    "n_import": r"\brequire\s*\(\s*[\"'](?:http|https|child_process|net|dns|fs|os)['\"]\s*\)",
    "n_dynamic": r"\brequire\s*\(\s*(?![\"'][^\"']*[\"']\s*\))",
    "n_crypto": r"\b(?:createHash|createCipher|createDecipher(?:iv)?|createSign|createVerify|createHmac|publicEncrypt|privateDecrypt|randomBytes|scrypt|pbkdf2)\s*\(",
    "n_timer": r"\b(?:setTimeout|setInterval|setImmediate)\s*\(",
    "n_string": r"\b(?:String\.fromCharCode|charCodeAt|Buffer\.from|atob|btoa|decodeURIComponent|unescape)\s*\(",
    "n_base64": r"^[A-Za-z0-9+/=]+$",
}
TWIN = {
    "n_dynamic": r"\brequire\s*\((?:\s|[^\s\"']|\z|[\"'][^\"']*(?:\z|[\"']\s*(?:[^\s)]|\z)))",
    "node_e_loader": r"(?i)node\s+-[ep]\b.*(?:Buffer\.from|atob|eval|Function|http|https|curl|wget|base64)",
    "dyn_require": r"\brequire\s*\(\s*(?:[^\s'\"]|\z)",
}

# --- fixed values: names and terms ---------------------------------------------------------------------------------
TOP_NAMES = "lodash chalk request commander express debug async bluebird moment react underscore fs-extra glob mkdirp minimist uuid through2 rimraf semver yargs colors readable-stream graceful-fs inherits string-decoder axios webpack babel-core classnames prop-types jquery body-parser typescript tslib rxjs zone.js core-js inquirer ora dotenv aws-sdk ejs mongoose passport socket.io eslint prettier nodemon jest mocha".split()
URL_WHITELIST = ["registry.npmjs.org", "registry.yarnpkg.com", "github.com", "githubusercontent.com"]
NETWORK_TERMS = ["curl", "wget", "fetch(", "axios", "request(", "http://", "https://", "invoke-webrequest", "downloadfile"]
SHELL_TERMS = ["child_process", "exec(", "execsync", "spawn(", "powershell", "cmd.exe", "bash", "sh -c", "nc ", "netcat"]
SECRET_TERMS = ["process.env", "npm_config", "npm config", "token", "secret", "password", "api_key", "apikey", "ssh", ".npmrc"]
OBFUSCATION_TERMS = ["eval(", "function(", "atob(", "base64", "fromcharcode", "\\x", "buffer.from"]
BUILD_TERMS = ["node-gyp", "prebuild-install", "cmake-js", "node-pre-gyp", "tsc", "webpack", "rollup", "vite", "esbuild", "npm run build"]
NODE_TYPES = "expression_statement call_expression member_expression identifier string template_literal assignment_expression variable_declaration function_declaration arrow_function if_statement for_statement try_statement import_statement binary_expression return_statement object_expression array_expression new_expression await_expression yield_expression class_declaration".split()
LIFECYCLE = ["preinstall", "install", "postinstall"]

# --- fixed values: scores and weights of rules -----------------------------------------------------------------------
SEVERITY = {"CRIT": ("critical", 10.0), "HIGH": ("high", 5.0), "MED": ("medium", 2.0)}
SCORE = {
    "CRIT_DYNAMIC_REQUIRE_EXEC": 15.0, "HIGH_ENCODED_PAYLOAD_CHAIN": 8.0, "HIGH_DNS_EXFIL": 8.0, "HIGH_SELF_DELETE": 8.0, "HIGH_RUNTIME_PROTOTYPE_POLLUTION": 7.0, "MED_SUSPICIOUS_PACKAGE_STRUCTURE": 3.0,
    "CRIT_MANIFEST_CURL_PIPE": 15.0, "CRIT_MANIFEST_NODE_EVAL": 15.0, "HIGH_MANIFEST_ENCODED_PAYLOAD": 8.0, "HIGH_MANIFEST_SUSPICIOUS_URL": 8.0, "MED_MANIFEST_INSTALL_HOOK_ONLY": 3.0,
}
LIVE_WEIGHT = {
    "CRIT_INSTALL_HOOK_EXEC": 1.0, "CRIT_EXFIL_CREDENTIALS": 1.0, "CRIT_MANIFEST_CURL_PIPE": 1.0, "CRIT_MANIFEST_NODE_EVAL": 1.0, "HIGH_DNS_EXFIL": 1.0, "HIGH_SELF_DELETE": 1.0, "HIGH_MANIFEST_SUSPICIOUS_URL": 1.0, "HIGH_OBFUSCATED_INSTALL": 1.0,
    "CRIT_INSTALL_HOOK_NETWORK": 0.95, "MED_SUSPICIOUS_PACKAGE_STRUCTURE": 0.7, "MED_MANIFEST_INSTALL_HOOK_ONLY": 0.7, "MED_EVAL_USAGE": 0.7, "CRIT_EXFIL_FILES": 0.7, "HIGH_EVAL_DECODED": 0.6, "HIGH_ENCODED_PAYLOAD_CHAIN": 0.6,
    "CRIT_REVERSE_SHELL": 0.3, "MED_INSTALL_HOOK_EXISTS": 0.2, "HIGH_WEBHOOK_EXFIL": 0.2, "HIGH_PROCESS_ENV_BULK": 0.2, "HIGH_RUNTIME_PROTOTYPE_POLLUTION": 0.2,
    "HIGH_STEGANOGRAPHIC_PAYLOAD": 0.1, "MED_NETWORK_PLUS_FS": 0.1, "CRIT_DYNAMIC_REQUIRE_EXEC": 0.1, "MED_MINIFIED_SINGLE_FILE": 0.0, "HIGH_TYPOSQUAT_SIGNAL": 0.0,
}
REPLAY_WEIGHT = {k: v for k, v in LIVE_WEIGHT.items() if k != "CRIT_MANIFEST_CURL_PIPE"} | {"CRIT_INSTALL_HOOK_NETWORK": 0.9, "HIGH_EVAL_DECODED": 0.5}
UNKNOWN_WEIGHT = 0.5
HARD = [
    "CRIT_INSTALL_HOOK_EXEC", "CRIT_EXFIL_CREDENTIALS", "CRIT_MANIFEST_CURL_PIPE", "CRIT_MANIFEST_NODE_EVAL", "HIGH_OBFUSCATED_INSTALL", "HIGH_DNS_EXFIL", "HIGH_SELF_DELETE", "HIGH_MANIFEST_SUSPICIOUS_URL",
    "MED_SUSPICIOUS_PACKAGE_STRUCTURE", "MED_MANIFEST_INSTALL_HOOK_ONLY", "MED_EVAL_USAGE", "CRIT_INSTALL_HOOK_NETWORK", "CRIT_EXFIL_FILES",
]
REPLAY_HARD = [r for r in HARD if r != "CRIT_MANIFEST_CURL_PIPE"]
NOISY = [
    "CRIT_DYNAMIC_REQUIRE_EXEC", "CRIT_REVERSE_SHELL", "HIGH_WEBHOOK_EXFIL", "HIGH_ENCODED_PAYLOAD_CHAIN", "HIGH_RUNTIME_PROTOTYPE_POLLUTION", "HIGH_STEGANOGRAPHIC_PAYLOAD", "MED_NETWORK_PLUS_FS", "MED_MINIFIED_SINGLE_FILE", "HIGH_TYPOSQUAT_SIGNAL",
]
RELIABLE = [
    "CRIT_INSTALL_HOOK_EXEC", "CRIT_EXFIL_CREDENTIALS", "CRIT_MANIFEST_NODE_EVAL", "HIGH_OBFUSCATED_INSTALL", "HIGH_DNS_EXFIL", "HIGH_SELF_DELETE", "HIGH_MANIFEST_SUSPICIOUS_URL", "MED_SUSPICIOUS_PACKAGE_STRUCTURE", "MED_MANIFEST_INSTALL_HOOK_ONLY", "CRIT_INSTALL_HOOK_NETWORK",
]

# --- fixed values: thresholds ------------------------------------------------------------------------------------------
LIVE = {"direct": 0.80, "hook_low": 0.35, "confirm": 0.45, "weighted": 1.0, "hard": 8.0, "hard_min_gnn": 0.0, "clean": 0.35}
REPLAY = {"direct": 0.80, "confirm": 0.45, "weighted": 1.0, "hard": 8.0, "hard_min_gnn": 0.45, "clean": 0.35}
SWEEP = {
    "direct": [0.78, 0.80, 0.82, 0.85, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98, 1.01],
    "confirm": [0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75],
    "weighted": [1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 12.0],
    "hard_min_gnn": [0.0, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75],
    "hard": [2.0, 5.0, 8.0, 10.0, 12.0, 15.0],
}

#: Verdict, words of the decision text in lower case, label; the first that fits. An empty verdict stands for any other.
DECISION_LABELS = [
    ("clean", "unavailable", "gnn_unavailable_clean"),
    ("clean", "confident clean", "gnn_confident_clean"),
    ("clean", "", "clean_pass"),
    ("malicious", "v2 install-hook recall block", "v2_install_hook_recall_block"),
    ("malicious", "v2 direct gnn block", "v2_gnn_direct_block"),
    ("malicious", "v2 gnn + weighted rules block", "v2_gnn_weighted_rules_block"),
    ("malicious", "v2 high-reliability rules block", "v2_hard_rules_block"),
    ("malicious", "critical behavioral rule", "critical_rule_block"),
    ("malicious", "very high confidence", "gnn_very_high_block"),
    ("malicious", "confirming rules", "gnn_rules_confirmed_block"),
    ("malicious", "gnn unavailable", "rules_only_block"),
    ("malicious", "", "malicious_block"),
    ("", "without strong static confirmation", "gnn_unconfirmed_review"),
    ("", "v2 review: low gnn", "v2_low_gnn_review"),
    ("", "v2 review: evidence below block thresholds", "v2_static_review"),
    ("", "v2 review: gnn-only uncertainty", "v2_gnn_review"),
    ("", "review-only critical", "review_only_critical"),
    ("", "gnn unavailable", "gnn_unavailable_review"),
    ("", "static evidence", "static_evidence_review"),
    ("", "rule", "static_evidence_review"),
    ("", "", "uncertain_review"),
]
HOOK_NETWORK_WORDS = ["http", "https", "fetch", "request", "axios", "curl", "wget", "net", "dns", "socket"]
#: Words of an error's text in lower case and its class; the first that fits, else "other".
BUILD_ERRORS = [("no js", "no_js_files"), ("no javascript", "no_js_files"), ("parse", "parse_error"), ("syntax", "parse_error"), ("tree_sitter", "parse_error"), ("empty", "empty_graph"), ("0 nodes", "empty_graph")]
#: Function on the stack and the step it belongs to; the first that fits, else "unknown".
FAILED_STEPS = [
    ("extract_ast", "AST parsing"),
    ("_walk_tree", "AST parsing"),
    ("extract_cfg", "CFG extraction"),
    ("extract_dfg", "DFG extraction"),
    ("get_node_features", "tensor construction: node features"),
    ("_build_metadata_tensor", "tensor construction: metadata"),
    ("_build_cpg_impl", "tensor construction/Data construction"),
]
#: Error categories that make an idea worthwhile, its area and the idea.
IDEAS = [
    ("very_high_gates", "precision", ["fp_gnn_very_high_without_rules"]),
    ("split_noisy_rules", "precision", ["fp_noisy_rule_confirmation", "fp_mixed_rule_confirmation"]),
    ("confirm_high_reviews", "recall", ["fn_high_gnn_no_rules", "fn_high_gnn_review_policy"]),
    ("confirm_mid_scores", "recall", ["fn_mid_gnn_no_rules", "fn_mid_gnn_weak_rules"]),
    ("retrain_low_scores", "model/data", ["fn_low_gnn_no_rules", "fn_low_gnn_weak_rules"]),
]
LOG_LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}


def severity(rule: str) -> str:
    return SEVERITY[rule.split("_")[0]][0]


def score(rule: str) -> float:
    return SCORE.get(rule, SEVERITY[rule.split("_")[0]][1])
