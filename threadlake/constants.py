"""Fixed values.

These must equal the values of the record formats the library reads, so that
results agree.  They are data, stated in their natural order.
"""

# -- field aliases: the first one that carries a value wins --------------------
CONVERSATION_ID_FIELDS = (
    "conversationId", "conversation_id", "mindConversationId", "mind_conversation_id",
    "threadId", "thread_id", "parentId",
)
MEDIA_CONVERSATION_FIELDS = (
    "conversationId", "conversation_id", "mindConversationId", "mind_conversation_id",
    "sessionId", "session_id",
)
MEDIA_MESSAGE_FIELDS = (
    "messageId", "message_id", "mindMessageId", "mind_message_id", "turnId", "turn_id",
)
RECORD_ID_FIELDS = ("id", "_id", "messageId", "conversationId")
CREATED_FIELDS = ("createdAt", "created_at", "createdAtUnixTimestamp", "created_at_unix_timestamp")
UPDATED_FIELDS = ("updatedAt", "updated_at", "updatedAtUnixTimestamp", "updated_at_unix_timestamp")
MODEL_FIELDS = ("modelName", "model_name", "model", "modelId", "model_id")
MODEL_ID_FIELDS = ("modelId", "model_id")
ROLE_FIELDS = ("role", "author", "type")
TITLE_FIELDS = ("title", "name", "subject", "agentName")
TEXT_FIELDS = ("text", "content", "output", "message", "input")
MIME_FIELDS = ("mimeType", "mime_type", "type", "contentType", "content_type")
FILE_NAME_FIELDS = ("fileName", "filename", "name")
DISPOSITION_FIELDS = ("mediaDisposition", "media_disposition", "mediaRole", "media_role")
INPUT_TOKEN_FIELDS = ("inputTokens", "input_tokens")
INPUT_TOKEN_USAGE_FIELDS = ("inputTokens", "input_tokens", "promptTokens", "prompt_tokens")
OUTPUT_TOKEN_FIELDS = ("outputTokens", "output_tokens")
OUTPUT_TOKEN_USAGE_FIELDS = ("outputTokens", "output_tokens", "completionTokens", "completion_tokens")
TOTAL_TOKEN_FIELDS = ("totalTokens", "total_tokens")
USAGE_FIELDS = ("usage", "tokenUsage", "token_usage")
DURATION_FIELDS = ("totalInferenceTime", "total_inference_time", "executionTime", "execution_time")
STATUS_FIELDS = ("streamingStatus", "streaming_status", "status")
ENVELOPE_FIELDS = ("documentData", "data", "doc", "value")
PAYLOAD_FIELDS = ("contentBinary", "content_binary", "binaryContent")

# -- store names decide the target table: (pattern, target) --------------------
STORE_ROUTES = (
    ("^(rxdb-physical:|idb:)", "lossless"),
    ("^studio(Image|Video|Audio)Sessions$", "studio_session"),
    ("^studio(Image|Video|Audio)Turns$", "studio_turn"),
    ("^(conversations|rxConversations|mindConversations|supportBotThreads)$", "conversation"),
    ("^(messages|rxMessages|mindMessages|supportBotMessages)$", "message"),
    ("(?i)(media|images|videos|attachments|audio)", "media"),
)
CORE_STORES = (
    "conversations", "messages", "rxConversations", "rxMessages", "mindConversations", "mindMessages",
)
INLINE_MEDIA_EXCLUDED = "^(rxdb-physical:|idb:|rxdb:rx-migration-state-meta-)"
INLINE_MEDIA_STORES = (
    "(?i)(message(Images|Videos|AudioAttachments|FileAttachments|ImageAttachments|VideoAttachments)"
    "|rxMessageImages|mind(Attachments|Media)|studio(Audio|Image|Video).*Media|Media)$"
)
STUDIO_QUEUE_KEY = "(?i)^video-studio-(active|pending|failed)-generations$"

# -- media: extension, MIME type, kind ------------------------------------------
URL_MIME_TYPES = (
    ("avif", "image/avif"), ("bmp", "image/bmp"), ("heic", "image/heic"), ("heif", "image/heif"),
    ("tif", "image/tiff"), ("tiff", "image/tiff"), ("webp", "image/webp"), ("png", "image/png"),
    ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("svg", "image/svg+xml"),
    ("mp4", "video/mp4"), ("webm", "video/webm"), ("mov", "video/quicktime"), ("m4v", "video/x-m4v"),
    ("avi", "video/x-msvideo"), ("mkv", "video/x-matroska"), ("ogv", "video/ogg"), ("mp3", "audio/mpeg"),
    ("wav", "audio/wav"), ("ogg", "audio/ogg"), ("m4a", "audio/mp4"), ("aac", "audio/aac"),
    ("flac", "audio/flac"), ("opus", "audio/opus"), ("pdf", "application/pdf"),
)
MIME_EXTENSIONS = (
    ("image/avif", "avif"), ("image/bmp", "bmp"), ("image/heic", "heic"), ("image/heif", "heif"),
    ("image/tiff", "tiff"), ("image/webp", "webp"), ("image/png", "png"), ("image/jpeg", "jpg"),
    ("image/gif", "gif"), ("image/svg+xml", "svg"), ("video/mp4", "mp4"), ("video/webm", "webm"),
    ("video/quicktime", "mov"), ("video/x-msvideo", "avi"), ("video/x-matroska", "mkv"),
    ("video/ogg", "ogv"), ("audio/mpeg", "mp3"), ("audio/wav", "wav"), ("audio/ogg", "ogg"),
    ("audio/mp4", "m4a"), ("audio/aac", "aac"), ("audio/flac", "flac"), ("audio/opus", "opus"),
    ("text/plain", "txt"), ("text/markdown", "md"), ("text/csv", "csv"), ("text/html", "html"),
    ("text/xml", "xml"), ("application/pdf", "pdf"),
)
DEFAULT_MIME = (("image", "image/webp"), ("video", "video/mp4"), ("audio", "audio/mpeg"))
DEFAULT_MIME_OTHER = "application/octet-stream"
DEFAULT_EXTENSION = (("image", "webp"), ("video", "mp4"), ("audio", "mp3"))
DEFAULT_EXTENSION_OTHER = "bin"
VIDEO_EXTENSIONS = "mp4|mov|webm|m4v|avi|mkv|ogv|mpeg|mpg"
AUDIO_EXTENSIONS = "mp3|wav|ogg|m4a|aac|flac|opus"
IMAGE_EXTENSIONS = "png|jpg|jpeg|gif|webp|svg|bmp|avif|heic|heif|tiff|jfif"
REFERENCE_EXTENSIONS = (
    "png|jpe?g|gif|webp|svg|bmp|avif|heic|heif|tiff|mp4|mov|webm|m4v|avi|mkv|ogv|mpeg|mpg|"
    "mp3|wav|ogg|m4a|aac|flac|opus|pdf"
)
ATTACHMENT_EXTENSIONS = (
    "png|jpe?g|gif|webp|svg|bmp|avif|heic|heif|tiff|mp4|mov|webm|m4v|avi|mkv|ogv|mpeg|mpg|"
    "mp3|wav|ogg|m4a|aac|flac|opus"
)
REFERENCE_HINTS = "image|video|audio|media|asset|attachment|file|download|preview|source|output|result|render|recording"
ATTACHMENT_HINTS = "attachment|file|media|asset|image|video|audio|upload|blob|download|preview|render|recording"
ATTACHMENT_TYPES = "attachment|file|media|asset|image|video|audio|upload|blob|document"
NO_BYTES_REASON = "No bytes, inline payload, or fetchable media URL was available."
# detected by extension when the bytes carry no known signature
FILE_TYPES = (
    (".png", "image/png", "image"), (".jpg", "image/jpeg", "image"), (".jpeg", "image/jpeg", "image"),
    (".webp", "image/webp", "image"), (".gif", "image/gif", "image"), (".avif", "image/avif", "image"),
    (".mp4", "video/mp4", "video"), (".mov", "video/quicktime", "video"), (".webm", "video/webm", "video"),
    (".mp3", "audio/mpeg", "audio"), (".wav", "audio/wav", "audio"), (".m4a", "audio/mp4", "audio"),
    (".aac", "audio/aac", "audio"), (".flac", "audio/flac", "audio"), (".ogg", "audio/ogg", "audio"),
    (".pdf", "application/pdf", "file"),
)

# -- keys that never leave the browser unredacted -----------------------------------
SENSITIVE_KEY = (
    r"(?i)(^|[-_.:])(access[-_.]?token|refresh[-_.]?token|id[-_.]?token|auth[-_.]?token|oauth|credential"
    r"|password|secret|private[-_.]?key)($|[-_.:])"
)
SENSITIVE_WALLET = r"(?i)walletconnect|wagmi\.store"
SENSITIVE_EXACT = "encryptionKey"
SENSITIVE_SESSION_KEY = r"(?i)(^|[-_.:])(session[-_.]?id|session[-_.]?token|attestation|trace)($|[-_.:])"
# after the name of a site, which the caller gives
SENSITIVE_SESSION_NAMES = "Session(Id|StartTime)$"
VOLATILE_KEY = (
    r"(?i)posthog|sentry|analytics|telemetry|amplitude|mixpanel|segment|previous[-_.:]?trace|survey"
)
VOLATILE_SESSIONS = "ActiveSessions$"
SENSITIVE_FIELD = (
    "(?i)^(accessToken|refreshToken|idToken|authToken|oauthToken|password|secret|privateKey|credential)$"
)
SENSITIVE_REASON = "Authentication or credential state is intentionally excluded."
SENSITIVE_SESSION_REASON = "Session, authentication, or telemetry identifier intentionally excluded."
VOLATILE_REASON = "Volatile telemetry state is intentionally excluded."

# -- ordering and labels -------------------------------------------------------------
DISPOSITION_ORDER = (("input", 0), ("output", 1), ("media", 2))
COMPARE_STATUS_ORDER = (("restore", 0), ("conflict", 1), ("backup-new", 2), ("synced", 3))
SCHEMA_VERSION = "1.0.0"
EMPTY_MESSAGE = "No readable content captured for this message."

# -- generation settings: label and field ----------------------------------------------
VIDEO_SETTINGS = (
    ("Duration", "duration"), ("Aspect Ratio", "aspectRatio"), ("Resolution", "resolution"),
    ("Audio", "audio"), ("Variants", "variants"),
)
IMAGE_SETTINGS = (
    ("Aspect Ratio", "aspectRatio"), ("Resolution", "resolution"), ("Format", "format"), ("Steps", "steps"),
    ("CFG Scale", "cfgScale"), ("Variants", "variants"), ("Style Preset", "stylePreset"), ("Seed", "customSeed"),
    ("Creativity", "enhanceCreativity"), ("Replication", "replication"), ("Auto Enhance", "autoEnhance"),
    ("Upscale Enhance", "upscaleEnhance"), ("Upscale Scale", "upscaleScale"), ("Negative Prompt", "negativePrompt"),
    ("Web Search", "enableWebSearch"), ("Hide Watermark", "hideWatermark"),
)
