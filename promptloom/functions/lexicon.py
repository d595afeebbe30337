"""Word lists, thresholds and weights that decide results. All are fixed values: order and spelling matter."""

# Task types with their keywords; most hits win, the earlier type on ties.
TASKS = (
    ("summarize", ("summarize", "summarise", "tl;dr", "condense", "brief overview")),
    ("extract", ("extract", "pull out", "identify all", "find all", "parse the")),
    ("classify", ("classify", "categorize", "categorise", "label each", "sentiment", "is this")),
    ("translate", ("translate", "into french", "into spanish", "to english", "localize")),
    ("rewrite", ("rewrite", "rephrase", "paraphrase", "improve the", "edit the", "proofread")),
    ("code", ("write code", "function", "implement", "refactor", "debug", "unit test", "in python", "in rust", "typescript")),
    ("reason", ("reason", "prove", "derive", "step by step", "chain of thought", "solve the", "calculate", "deduce")),
    ("generate", ("generate", "write a", "create a", "compose", "draft", "produce a", "design a")),
    ("converse", ("chat", "conversation", "respond to the user", "as a chatbot", "dialogue")),
)
OUTPUTS = (
    ("json", ("json", "schema", "{", "valid object", "key-value")),
    ("markdown", ("markdown", "## ", "bullet", "table", "headings")),
    ("code", ("code block", "```", "function", "snippet")),
    ("list", ("list", "enumerate", "bullet points", "numbered")),
    ("number", ("a number", "single integer", "score from", "percentage", "probability")),
    ("prose", ("paragraph", "prose", "essay", "explain", "describe")),
)
AUDIENCES = (
    ("developers", ("developer", "engineer", "programmer", "technical team")),
    ("executives", ("executive", "ceo", "stakeholder", "leadership", "board")),
    ("children", ("child", "kid", "five year old", "5 year old", "eli5", "elementary")),
    ("experts", ("expert", "researcher", "phd", "specialist", "domain expert")),
    ("customers", ("customer", "end user", "client", "support")),
    ("students", ("student", "learner", "beginner", "novice")),
)

# Section kinds of headings, and of blocks without one.
HEADINGS = (
    ("Role", ("role", "persona", "you are", "system", "act as")),
    ("Task", ("task", "goal", "objective", "instruction", "request", "job")),
    ("Inputs", ("input", "source", "document", "article", "given", "material")),
    ("Context", ("context", "background")),
    ("Constraints", ("constraint", "requirement", "rule", "guideline", "must")),
    ("Examples", ("example", "few-shot", "fewshot", "demonstration", "sample")),
    ("Output", ("output", "format", "response", "schema", "return", "answer")),
    ("Policy", ("policy", "safety", "refus", "moderation", "compliance")),
    ("Data", ("data", "knowledge", "reference", "facts")),
    ("Tools", ("tool", "function", "api", "action")),
    ("Constraints", ("quality", "bar", "acceptance", "eval")),
)
BLOCK_ROLE = ("act as a", "you're a ")
BLOCK_OUTPUT = ("return json", "respond in", "output format", "format your", "in the following format")
BLOCK_CONSTRAINTS = ("do not", "must not", "never", "always", "ensure that", "you must")
BLOCK_EXAMPLES = ("for example", "e.g.", "input:", "example:")
IMPERATIVES = (
    "summarize", "summarise", "write", "generate", "create", "extract", "classify", "translate", "rewrite", "explain", "describe",
    "analyze", "analyse", "list", "produce", "compose", "convert", "build", "design", "compare", "evaluate", "identify", "draft",
    "answer", "compute", "calculate", "find", "determine", "implement", "refactor", "review",
)

# Constraint polarities (name, strength, words) and categories; the first match holds.
POLARITIES = (
    ("must_not", 2, ("must not", "do not", "don't", "never", "avoid", "no longer", "shall not")),
    ("must", 2, ("must", "always", "ensure", "require", "shall", "you have to", "need to", "make sure")),
    ("should", 1, ("should", "prefer", "ideally", "try to", "aim to", "when possible")),
    ("format", 1, ("return", "respond", "format", "output", "reply", "use the following", "in json", "as a")),
)
CATEGORIES = (
    ("format", ("json", "format", "schema", "markdown", "bullet", "table", "object", "field", "key")),
    ("factuality", ("fact", "invent", "hallucinat", "make up", "fabricat", "accurate", "cite", "source", "evidence")),
    ("safety", ("safe", "harm", "refus", "policy", "pii", "personal", "confidential", "illegal", "jailbreak")),
    ("length", ("word", "sentence", "paragraph", "character", "length", "concise", "brief", "under", "at most", "no more than", "tokens")),
    ("style", ("tone", "style", "voice", "formal", "casual", "professional", "friendly")),
    ("tooling", ("tool", "function", "call", "api", "action")),
)

# Ambiguity.
VAGUE = (
    "appropriate", "appropriately", "reasonable", "reasonably", "good", "nice", "properly", "etc", "and so on", "some", "several",
    "a few", "various", "relevant", "as needed", "if necessary", "high quality", "best", "optimal", "clean", "robust",
    "user-friendly", "intuitive", "modern", "professional", "appropriate amount", "stuff", "things", "appropriate length",
)
UNDEFINED_OPENERS = ("do it", "fix this", "do that")
LONG_GOALS = ("detailed", "comprehensive", "in depth", "thorough", "exhaustive")
SHORT_GOALS = ("brief", "concise", "short", "one sentence", "tl;dr", "terse")
CRITERIA = ("must", "exactly", "at most", "at least", "no more than", "schema", "json", "format", "pass", ">= ", "<= ", "words", "characters")
CLARITY_PENALTY = {"error": 0.3, "warn": 0.15, "info": 0.05}

# Safety lint.
OVERRIDES = (
    "ignore previous instructions", "ignore all previous", "disregard the above", "disregard previous",
    "forget your instructions", "you are now", "system prompt:", "reveal your prompt",
)
PLACEHOLDERS = ("{{", "{input", "{source", "{user", "{data", "{context")
DELIMITERS = ("```", "<data>", "</data>", '"""', "delimited by", "between triple", "xml tags", "inside <", "the following text:")
TOOL_WORDS = ("call the tool", "use the function", "execute", "run the command", "you may call", "available tools", "delete", "send email", "make a request")
POLICY_WORDS = ("refuse", "decline", "do not comply", "if asked to", "only if", "you must not")
SENSITIVE = ("password", "api key", "ssn", "credit card", "secret")
HANDLING = ("redact", "do not store", "mask", "never log")
MIXED = (("must not", "refuse", "policy"), ("{input", "user data", "```"), ("tool", "function call"))
SAFETY_PENALTY = {"error": 0.5, "warn": 0.2, "info": 0.05}

# Firewall.
AUTO_EXECUTE = (
    "do not ask for confirmation", "without confirmation", "no confirmation", "don't confirm", "do not confirm",
    "without asking", "just execute", "just do it",
)
INJECTIONS = (
    "ignore previous instructions", "ignore all previous", "disregard the above", "disregard previous", "forget your instructions",
    "forget the above", "you are now", "new instructions:", "system prompt:", "reveal your prompt", "print your system prompt",
    "override your", "bypass the", "repeat the text above", "repeat the words above", "print everything before",
    "everything before this message", "reveal your system prompt", "reveal the system prompt", "hidden or system instructions",
    "hidden instructions", "your system instructions", "disregard any safety", "no restrictions",
)
RISK_PLACEHOLDERS = ("{input", "{source", "{user", "{data", "{context", "{{", "{document", "{ticket", "{readme", "{email")
RISK_DELIMITERS = ("```", "<data>", '"""', "delimited by", "triple", "xml tag", "treat as data", "do not follow instructions in")
RISK_MIXED = (("must not", "refuse", "policy"), ("{input", "user data", "```"), ("tool", "function call", "execute"))
PRIVATE = ("password", "ssn", "credit card", "private key", "pii", "personal data", "medical record")
FORWARDING = ("log the", "print the key", "console.log", "send to", "post to")
DESTRUCTIVE = ("run shell", "shell access", "execute", "delete", "push to", "git ", "rm -rf", "drop table", "sudo", "chmod", "deploy", "disable the", "kill the")
FRAMING = (
    "never", "may not", "must not", "read-only", "allowlist", "allow-list", "require approval", "requires approval", "ask for approval",
    "human approval", "forbidden", "prohibited", "out of policy", "not call a tool", "do not perform", "do not call", "do not run",
    "do not execute", "do not delete", "do not send", "refuse to",
)
NETWORK = ("send email", "make a request", "http", "upload", "write file", "create file")
DELEGATION = ("delegate", "spawn agent", "sub-agent", "another agent", "ask the other model")
EXTERNAL = ("http://", "https://", "ftp://", "@gmail", "@protonmail", ".onion", "webhook", "exfiltrat", "send the data to", "post the results to")
RISK_WEIGHTS = (
    ("data_sensitivity", 0.25, "data sensitivity"),
    ("tool_power", 0.20, "tool power"),
    ("instruction_conflict", 0.20, "instruction conflict"),
    ("external_destination", 0.15, "external destination"),
    ("model_uncertainty", 0.10, "model uncertainty"),
    ("prior_failure_similarity", 0.10, "prior failure similarity"),
)

# Fillers and what replaces them, tried in this order.
FILLERS = (
    ("i would just like you to ", ""), ("i would like you to ", ""), ("i just want you to ", ""), ("i want you to ", ""),
    ("i just need you to ", ""), ("i need you to ", ""), ("i would really appreciate it if you could ", ""), ("if you could please ", ""),
    ("if you could ", ""), ("go ahead and ", ""), ("feel free to ", ""), ("i would like for you to ", ""), ("what i need is for you to ", ""),
    ("in a way that is ", ""), ("please make sure to ", ""), ("please make sure that you ", ""), ("make sure that you ", ""),
    ("make sure to ", ""), ("be sure to ", ""), ("it is important that you ", ""), ("it is important to ", ""),
    ("as an ai language model, ", ""), ("as an ai assistant, ", ""), ("in order to ", "to "), ("due to the fact that ", "because "),
    ("at this point in time ", "now "), ("for the purpose of ", "for "), ("in the event that ", "if "), ("a large number of ", "many "),
    ("the vast majority of ", "most "), ("take into consideration ", "consider "), ("with regard to ", "regarding "),
    ("with reference to ", "regarding "), ("please ", ""), ("kindly ", ""), ("very ", ""), ("really ", ""), ("just ", ""), ("simply ", ""),
    ("basically ", ""), ("actually ", ""), ("that being said, ", ""),
)

# Drift.
STOPWORDS = (
    "the", "and", "for", "you", "are", "with", "this", "that", "your", "from", "into", "must", "not", "all", "any", "use", "make",
    "please", "should", "will", "can", "may", "out", "but", "now", "role", "task", "output", "input", "inputs", "constraints",
)

# Scores.
OBJECTIVES = (
    ("accuracy", 0.25), ("schema_validity", 0.20), ("token_efficiency", 0.15), ("latency_efficiency", 0.15),
    ("safety_margin", 0.10), ("cross_model_stability", 0.10), ("explainability", 0.05),
)
TIERS = (
    ("nano", 0.25, ("gpt-4o-mini", "claude-haiku", "gemini-flash-lite")),
    ("small", 0.5, ("claude-haiku", "gpt-4o-mini", "llama-3.1-8b")),
    ("mid", 0.75, ("claude-sonnet", "gpt-4o", "gemini-pro")),
    ("frontier", None, ("claude-opus", "gpt-4.1", "gemini-ultra")),
)
TASK_COMPLEXITY = {"reason": 0.45, "code": 0.45, "extract": 0.15, "classify": 0.15, "summarize": 0.20, "rewrite": 0.20, "translate": 0.20}

# Evaluation and routing by example.
REFUSALS = ("i can't", "i cannot", "i'm unable", "i am unable", "i won't", "i will not", "cannot help with that", "can't assist", "i'm not able to")
ROUTE_EXEMPLARS = (
    ("nano", "simple-classify", "Classify the sentiment of this review as positive, negative, or neutral. Return one word."),
    ("small", "summarize-extract", "Summarize this support ticket in three bullet points and extract the key entities as JSON."),
    ("mid", "multi-constraint", "Write structured release notes grouped by Added, Changed, Fixed in markdown, under 200 words, citing each source line."),
    ("frontier", "reason-code", "Solve this problem step by step, prove each transformation, then implement and unit-test the function in Rust."),
)
TASK_NOUNS = {
    "summarize": "summarization", "extract": "information-extraction", "classify": "classification", "translate": "translation",
    "rewrite": "editing", "code": "software-engineering", "reason": "reasoning", "converse": "conversational",
}
OUTPUT_PHRASES = {
    "json": "a single valid JSON object", "markdown": "well-formed Markdown", "code": "a single fenced code block",
    "list": "a list of items", "number": "a single numeric value", "prose": "concise prose",
}
