"""Values that results depend on."""

# Text formats, prompts, limits and lookup tables that outputs must match.
EXTRACT_HEADER = "## Extracted by {model} (Ollama)\n\n"
EXTRACT_ERROR = "[Ollama Error: {error}]"
TRANSLATE_ERROR = "[Translation Error: {error}]"
FILE_ERROR = "[Error processing {name}: {error}]"
REGION_HEADER = "### REGION {order}\n"
RETRY_HEADER = "\n\n### RETRIED REGION {order}\n"
VISION_USER_LINE = "Please process this image according to the system instructions."
TRANSLATE_SYSTEM = "You are a professional translator. Translate the text into {target_lang} with a {tone} tone. Output ONLY the translated text. Do not add explanations or preambles."
TRANSLATE_USER = "<source_document>\n{text}\n</source_document>"
BATCH_FILE = "--- {filename} ---\n\n{text}\n\n"
DEFAULT_OPTIONS = {"temp": 0.1, "top_p": 0.9, "max_tokens": 4096}
DEFAULT_TONE = "Professional"
TONES = ("Professional", "Casual", "Academic")
TARGET_LANGS = ("Chinese (Simplified)", "Chinese (Traditional)", "English", "French", "German", "Japanese", "Korean", "Portuguese (Brazil)", "Portuguese (Portugal)", "Spanish", "Vietnamese")
TRANSLATOR_FAMILIES = ("qwen", "llama", "mistral", "gemma")
REQUIRED_MODELS = (
    ("mistral-small3.1:latest", "Mistral Small"),
    ("gemma4:31b", "Gemma 4"),
    ("Keyvan/german-ocr-3.1:latest", "German-OCR"),
    ("qwen2.5:32b", "Qwen 2.5 32B"),
    ("llama3.1:8b", "Llama 3.1 8B"),
)
#: (model, id, label, type, min, max, step, default)
MODEL_PARAMS = (
    ("mistral-small3.1", "temp", "TEMP", "range", 0.0, 1.0, 0.1, 0.1),
    ("mistral-small3.1", "max_tokens", "MAX TOKENS", "number", None, None, None, 4096.0),
    ("german-ocr-3.1", "temp", "TEMP", "range", 0.0, 1.0, 0.1, 0.1),
)
LOG_KEEP = 50
DPI_CHOICES = (150, 300, 600)
DEFAULT_STRENGTH = 15
A4_WIDTH_INCHES = 8.27
PDF_LINES_PER_PAGE = 54
EXTRACT_TIMEOUT_S, PULL_TIMEOUT_S, LIST_TIMEOUT_S, STATUS_TIMEOUT_S = 900, 3600, 5, 0.5
