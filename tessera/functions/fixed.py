"""Fixed values that must equal the reference for results to match.

Everything here is data, not logic: chat-template formats, the pre-token
patterns, special markers and numeric constants.  Rows and patterns are kept
in their natural (registration) order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: numeric constants
# ---------------------------------------------------------------------------
IGNORE_INDEX = -100          # label value that is never supervised
MAP_BATCH_SIZE = 8000        # rows per preparation batch
DEFAULT_MAX_SEQ_LEN = 512    # default maximum sequence length
SCORING_MAX_LEN = 4096       # default truncation of the scoring prompt
DEFAULT_TEMPLATE = "qwen"    # default chat template
DEFAULT_BETA = 0.1           # preference-loss temperature
DEFAULT_DRO_WEIGHT = 1.0     # DRO weight
DEFAULT_SEED = 42            # mixing seed

# ---------------------------------------------------------------------------
# FIXED VALUES: special markers of the tokeniser (ids 151643, 151644, 151645)
# ---------------------------------------------------------------------------
ENDOFTEXT = "<|endoftext|>"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
SPECIAL_TOKENS = (ENDOFTEXT, IM_START, IM_END)
EOS_TOKEN = ENDOFTEXT        # eos in the tokeniser file (pad and eos coincide)

# ---------------------------------------------------------------------------
# FIXED VALUES: pre-token patterns
# ---------------------------------------------------------------------------
# Full profile: the tokeniser's seven-branch split.  Java needs the (?U) flag
# so that \s and case folding are Unicode-aware like Python's `regex`.
FULL_PRETOKEN_PATTERN = (
    r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
)
# Portable profile (ours): letters runs, single digits, runs of anything that
# is neither whitespace, letter nor digit.  Whitespace is spelled out so that
# Java and RE2 agree byte for byte.
PORTABLE_PRETOKEN_PATTERN = r"[\p{L}]+|\p{N}|[^\t\n\x0B\f\r \p{L}\p{N}]+"
# Special markers are matched whole before anything else.
MARKER_PATTERN = r"<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>"

# ---------------------------------------------------------------------------
# FIXED VALUES: chat templates, in registration order.
# Columns: template_name, system_format, user_format, assistant_format,
#          system (default system text), stop_word.  None = absent.
# ---------------------------------------------------------------------------
_INTERNLM_SYSTEM = (
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"  # noqa: E501
    "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."  # noqa: E501
)
_LLAMA2_SYSTEM = (
    "You are a helpful, respectful and honest assistant. "
    "Always answer as helpfully as possible, while being safe. "
    "Your answers should not include any harmful, unethical, "
    "racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, "
    "explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)

TEMPLATE_ROWS = (
    ("default", "System: {content}\n\n", "User: {content}\nAssistant: ", "{content} {stop_token}", None, None),
    ("internlm", "<|System|>:{content}\n", "<|User|>:{content}\n<|Bot|>:", "{content}</s>\n", _INTERNLM_SYSTEM, "</s>"),
    ("internlm2", "<|im_start|>system\n{content}<|im_end|>\n",
     "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n",
     _INTERNLM_SYSTEM, "<|im_end|>"),
    ("qwen", "<|im_start|>system\n{content}<|im_end|>\n",
     "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n",
     "You are a helpful assistant.", "<|im_end|>"),
    ("yi", "<|im_start|>system\n{content}<|im_end|>\n",
     "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n", None, "<|im_end|>"),
    ("orion", "<s>", "Human: {content}\n\nAssistant: </s>", "{content}</s>", "", "</s>"),
    ("deepseek", None, "User: {content}\n\nAssistant: ", "{content}<｜end▁of▁sentence｜>", None, "<｜end▁of▁sentence｜>"),
    ("chatglm2", None, "[Round {idx}]\n\n问：{content}\n\n答：", "{content}", None, "</s>"),
    ("chatglm3", "{content}", "{content}", "{content}",
     "You are ChatGLM3, a large language model trained by Zhipu.AI. Follow the user's instructions carefully. Respond using markdown.",  # noqa: E501
     "</s>"),
    ("ziya2", None, "<human>:{content} <bot>:", "{content}</s>", None, "</s>"),
    ("xverse", None, "Human: {content}\n\nAssistant: ", "{content}<|endoftext|>", None, "<|endoftext|>"),
    ("minicpm", None, "<用户>{content}<AI>", "{content}</s>", None, "</s>"),
    ("zephyr", "<|system|>\n{content}</s>", "<|user|>\n{content}</s>\n<|assistant|>\n", "{content}</s>\n", None, "</s>"),
    ("mistral", "<s>", "[INST]{content}[/INST]", "{content}</s>", "", "</s>"),
    ("mixtral", "<s>", "[INST]{content}[/INST]", "{content}</s>", "", "</s>"),
    ("baichuan", None, "<reserved_102>{content}<reserved_103>", "{content}</s>", None, "</s>"),
    ("baichuan2", None, "<reserved_106>{content}<reserved_107>", "{content}</s>", None, "</s>"),
    ("vicuna", "{content}\n", "USER: {content} ASSISTANT:", "{content}</s>",
     "A chat between a curious user and an artificial intelligence assistant. "
     "The assistant gives helpful, detailed, and polite answers to the user's questions.", "</s>"),
    ("llama2", "<<SYS>>\n{content}\n<</SYS>>\n\n", "[INST]{content}[/INST]", "{content} </s>", _LLAMA2_SYSTEM, "</s>"),
    ("llama3", "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>",
     "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
     "{content}<|eot_id|>", None, "<|eot_id|>"),
    ("gemma", "<bos>", "<start_of_turn>user\n{content}<end_of_turn>\n<start_of_turn>model\n", "{content}<eos>\n", "",
     "<eos>"),
    ("phi3", None, "<|user|>\n{content}<|end|>\n<|assistant|>", "{content}<|end|>\n", None, "<|end|>"),
)

# Generic chat rendering of the tokeniser file: default system block emitted
# when the first message is not a system message; optional open assistant turn.
CHAT_DEFAULT_SYSTEM_BLOCK = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
CHAT_GENERATION_PROMPT = "<|im_start|>assistant\n"
