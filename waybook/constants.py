"""Names, tags, phrases and limits that results depend on."""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------

# Roles of a training conversation.
PROMPT_ROLES = ["human", "observation"]
RESPONSE_ROLES = ["gpt", "function_call"]

# Tool names, call style -> training style.
FOREIGN_TOOL_NAMES = {
    "serper_google_webpage_search": "web_search",
    "serper_fetch_webpage_content": "open_url",
    "semantic_scholar_snippet_search": "paper_search",
    "search_papers_by_relevance": "paper_search",
}
CHANNEL_TOOL_NAMES = {
    "browser.search": "web_search",
    "browser.open": "open_url",
    "browser.find": "find_text",
    "functions.paper_search": "paper_search",
    "functions.pubmed_search": "pubmed_search",
    "python.execute": "python",
    "functions.search": "web_search",
    "functions.browser": "open_url",
    "functions.web_search": "web_search",
    "functions.open": "open_url",
    "functions.web": "web_search",
    "functions.find": "find_text",
}
TAGGED_TOOL_BACKENDS = {
    "web_search": ("browser", "search"),
    "open_url": ("browser", "open"),
    "find_text": ("browser", "find"),
    "python": ("python", "execute"),
    "paper_search": ("functions", "paper_search"),
    "pubmed_search": ("functions", "pubmed_search"),
}

# Tool argument cleaning.
ALLOWED_ARGS = {
    "web_search": ["query", "topn"],
    "open_url": ["id", "cursor", "loc"],
    "find_text": ["pattern", "cursor"],
    "paper_search": ["query", "limit", "mode", "year", "fields_of_study", "venue"],
    "pubmed_search": ["query", "limit"],
}
ARG_RENAMES = {"top_n": "topn", "num_results": "topn"}
ARG_DEFAULTS = {("web_search", "topn"): 10}

# Tools counted in published tables.
VALID_TOOLS = [
    "browser.search",
    "browser.open",
    "browser.find",
    "functions.paper_search",
    "functions.pubmed_search",
]

# Server-tagged calls.
WRONG_CODE_TOOL_NAMES = ["python", "python_code"]
CODE_TOOL_NAME = "run_python_code"
CODE_SERVER_NAME = "tool-python"
TOOL_SERVERS = {
    "create_sandbox": "tool-python",
    "run_command": "tool-python",
    "run_python_code": "tool-python",
    "upload_file_from_local_to_sandbox": "tool-python",
    "download_file_from_internet_to_sandbox": "tool-python",
    "download_file_from_sandbox_to_local": "tool-python",
    "google_search": "search_and_scrape_webpage",
    "scrape_and_extract_info": "jina_scrape_llm_summary",
}
PROTOCOL_TAGS = [
    "<use_mcp_tool>",
    "</use_mcp_tool>",
    "<server_name>",
    "</server_name>",
    "<arguments>",
    "</arguments>",
]
REFUSAL_PHRASES = [
    "time constraint",
    "I’m sorry, but I can’t",
    "I'm sorry, I cannot solve",
]
MAX_ROLLBACKS = 5

# Answers that stand for "no answer".
PLACEHOLDER_ANSWERS = ["?", "??", "???", "？", "……", "…", "...", "unknown"]

# Replaced tool results.
OMITTED_RESULT = "Tool result is omitted to save tokens."

# Sites never shown to a model.
BANNED_URL_PARTS = ["unifuncs", "huggingface.co/datasets", "huggingface.co/spaces"]

# Gauges read from text metrics.
GAUGE_PREFIXES = {
    "running": "vllm:num_requests_running{",
    "waiting": "vllm:num_requests_waiting{",
    "cache_usage": "vllm:kv_cache_usage_perc{",
}

# Limits.
STORED_RESULT_CHARS = 30_000
SHOWN_RESULT_CHARS = 100_000
SCRAPED_CHARS = 409_600
HEARTBEAT_TIMEOUT_S = 120
