"""Fixed values.

Everything here is data that results must agree on: word lists, enum orders,
labels, remarks, patterns and file layouts.  Nothing in this module computes.
"""

# --- fixed values: suffixes that name files or server actions, never a TLD ---
FILE_EXTENSIONS = [
    "js", "css", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "vue", "ts", "jsx", "tsx", "py", "java", "c", "cpp", "h", "cs", "php", "rb",
    "go", "rs", "sh", "bat", "cmd", "ps1", "json", "xml", "yaml", "yml", "md", "txt", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip",
    "rar", "7z", "tar", "gz", "mp3", "mp4", "avi", "mov", "wav", "wasm", "map", "woff", "woff2", "ttf", "eot", "swf", "apk", "ipa", "dmg",
    "exe", "do", "action", "jsp", "asp", "aspx", "cgi", "htm", "html", "shtml",
]

# --- fixed values: identifiers that look like the first label of a domain ---
CODE_WORDS = [
    "window", "document", "console", "location", "history", "navigator", "screen", "event", "math", "json", "date", "array", "object", "string",
    "number", "boolean", "function", "symbol", "promise", "regexp", "error", "map", "set", "intl", "reflect", "proxy", "webassembly", "chrome",
    "obj", "item", "items", "data", "res", "req", "resp", "err", "msg", "node", "element", "elem", "el", "vm", "ctx", "this", "self", "parent",
    "top", "sub", "pub", "btn", "form", "page", "query", "result", "target", "source", "dest", "val", "value", "key", "name", "type", "index",
    "idx", "count", "total", "len", "length", "size", "config", "options", "opts", "params", "args", "param", "arg", "props", "prop", "state",
    "view", "model", "app", "user", "info", "text", "html", "body", "header", "footer", "title", "content", "url", "uri", "path", "href", "src",
    "route", "routes", "action", "method", "status", "code", "temp", "tmp", "util", "utils", "helper", "helpers", "myplayer", "player", "video",
    "video1", "audio", "image", "input", "win", "doc", "pub-title", "obju0", "intbro", "show", "style", "time", "id", "e", "t", "i", "v", "k",
    "p", "n", "s", "m", "d", "c", "b", "a", "x", "y", "z", "var", "let", "const", "return", "typeof", "instanceof", "delete", "void", "null",
    "undefined", "true", "false", "nan", "default", "import", "export",
]

# --- fixed values: TLDs that are also ordinary words or brands ---
DICTIONARY_TLDS = [
    "open", "target", "play", "click", "next", "now", "total", "data", "name", "chrome", "top", "do", "to", "mp", "post", "tab", "help", "link",
    "work", "live", "page", "call", "show", "like", "auto", "car", "pub", "bar", "movie", "date", "review", "id",
]

# --- fixed values: names that are never a finding ---
RESERVED_DOMAINS = ["localhost", "example.com", "example.org", "test.com"]

# --- fixed values: path suffixes that cannot hold crawlable HTML ---
NON_HTML_SUFFIXES = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "rtf", "wps", "zip", "rar", "7z", "tar", "gz", "bz2", "iso", "apk", "exe", "dmg",
    "msi", "pkg", "mp4", "mp3", "avi", "flv", "mkv", "mov", "wmv", "wav", "ogg", "webm", "m4a", "png", "jpg", "jpeg", "gif", "bmp", "svg",
    "webp", "ico", "tiff", "psd", "woff", "woff2", "ttf", "eot", "otf", "css", "js",
]

# --- fixed values: text content by path suffix ---
TEXT_PATH_SUFFIXES = [
    "html", "htm", "js", "css", "xml", "txt", "shtml", "do", "action", "jsp", "asp", "php",
]

# --- fixed values: allow-listed infrastructure ---
SAFE_ROOTS = [
    "cloudflare.com", "cdnjs.cloudflare.com", "jsdelivr.net", "jsdelivr.com", "unpkg.com", "bootcdn.net", "staticfile.org", "w3.org",
    "schema.org", "bootstrapcdn.com", "fontawesome.com", "jquery.com", "polyfill.io", "cdnjs.com", "baidu.com", "bdstatic.com", "qq.com",
    "gtimg.com", "tencent.com", "aliyun.com", "aliyuncs.com", "alicdn.com", "taobao.com", "tmall.com", "google.com", "gstatic.com",
    "googleapis.com", "google-analytics.com", "googletagmanager.com", "microsoft.com", "apple.com", "github.com", "githubusercontent.com",
    "weibo.com", "sina.com.cn", "jd.com", "amazon.com", "amazonaws.com", "huaweicloud.com", "myhuaweicloud.com", "volcengine.com",
    "volccdn.com", "qiniu.com", "qiniucdn.com", "upyun.com", "bytedance.com", "douyin.com", "miit.gov.cn", "beian.miit.gov.cn", "conac.cn",
    "bszs.conac.cn", "12377.cn", "12321.cn", "mps.gov.cn", "gov.cn",
]
SAFE_SUFFIXES = [".gov.cn", ".edu.cn"]

# --- fixed values: link prefixes that lead nowhere on the web ---
DEAD_LINK_PREFIXES = ["#", "javascript:", "mailto:", "tel:", "data:", "vbscript:", "sms:"]
DEAD_ENDPOINT_PREFIXES = ["#", "javascript:", "data:", "{", "$"]

# --- fixed values: enum orders, most severe first ---
RISK_LEVELS = ["critical", "high", "medium", "low", "safe", "pending"]
RISKY_LEVELS = ["critical", "high", "medium", "low"]
TOP_RISK_LEVELS = ["critical", "high", "medium"]
VERIFY_STATES = ["verified_failed", "verified_clean", "error", "unverified"]
OPEN_STATES = ["unverified", "verified_failed"]
CLOSED_STATES = ["verified_clean", "page_removed"]
MANUAL_STATES = ["pending", "in_progress", "resolved", "ignored"]

# --- fixed values: source types that count as text, all others are links ---
TEXT_SOURCE_TYPES = ["query_param_domain", "comment", "script_code", "plain_text", "css_file_text"]

# --- fixed values: asset tags and attributes, in scan order ---
ASSET_SPECS = [
    ("img", "src"), ("img", "data-src"), ("img", "data-original"),
    ("script", "src"), ("link", "href"), ("iframe|frame", "src"),
    ("video|audio|source|track", "src"), ("form", "action"),
    ("object", "data"), ("embed", "src"),
]

# --- fixed values: limits ---
EVIDENCE_PER_DOMAIN = 5
RAW_MATCH_CHARS = 500
SNIPPET_CHARS = 1000
URL_BYTES = 2000
URL_CHECK_CHARS = 800
ASSET_BYTES = 3 * 1024 * 1024
LOG_TTL_DAYS = 90

# --- fixed values: remarks written to rows ---
REMARK_RULE_HIT = "命中预设风险情报: "
REMARK_RULE_INHERITED = "继承自全局情报规则: "
REMARK_SAFE = "公认知名公共云、主流CDN或官方合规基础设施"
TAG_SAFE = "主流CDN/白名单"
REMARK_REOPENED_MARK = "工单重新打开"
REMARK_PAGE_CLEARED = "系统自动复测：违规外链已清除，工单自动完结"
REMARK_DOMAIN_CLEARED = "系统复测已清除，工单自动完结"
REMARK_REAPPEARED = "【复测告警】检测到违规外链再次出现，工单重新打开待处置"
REMARK_ROLLBACK = "【防回滚告警】已修复记录重新检测到违规外链，工单重新打开待处置"
DETAIL_ROLLBACK = "【防回滚复测告警】已修复记录重新检测到风险域名！"
DETAIL_ALL_CLEARED = "【系统复测】所有涉险页面均已完成修复清除，工单闭环。"

# --- fixed values: retest texts; {0} {1} are filled with columns ---
PAGE_GONE = "页面返回 HTTP {0}，涉险页面已下线或删除，风险解除。"
PAGE_GONE_BODY = "页面返回 HTTP {0} (包含404提示)，涉险页面已失效。"
PAGE_SERVER_ERROR = "页面服务器内部错误 (HTTP {0})，暂无法判定。"
PAGE_STILL_THERE = "HTTP {0} 正常访问，源码中仍检测到违规域名 [{1}]，未完成修复。"
PAGE_CLEARED = "HTTP {0} 正常访问，源码中未检测到违规域名 [{1}]，已成功修复清除。"
PAGE_TIMEOUT = "页面请求超时 (超 8 秒未响应)，暂无法判定。"
PAGE_UNREACHABLE = "页面连接失败或域名已无法解析 ({0})，可能已下线。"
PAGE_OTHER_ERROR = "请求异常: {0}"
DOMAIN_PAGE_GONE = "页面返回 HTTP {0}，原始涉险页面已彻底下线移除"
DOMAIN_PAGE_CLEARED = "HTTP {0} 正常响应，但在源码中未发现该域名代码"
DOMAIN_PAGE_TIMEOUT = "请求超时（超过10秒未能获取响应）"
DOMAIN_PAGE_ERROR = "访问失败: {0}"
VERDICT_FAILED = "复测全量 {0} 个历史页面，在 {1} 处仍检测到该外部域名代码，未完全清除！"
VERDICT_CLEAN = "复测全量 {0} 个历史页面，均已无该外部域名代码，确认修复已闭环！"
VERDICT_ERROR = "复测 {0} 个页面均访问超时或连接异常，请检查网络或目标服务状态。"
VERDICT_NONE = "未找到原始涉险页面 URL 记录，无法执行复测"

# --- fixed values: transport errors of a stored response ---
ERROR_TIMEOUT = "Request Timeout"
ERROR_CONNECT = "Connection Failed"
ERROR_ASSET_SIZE = "Asset exceeds max size limit"

# --- fixed values: export labels ---
RISK_LABELS = {
    "critical": "严重(Critical)", "high": "高危(High)", "medium": "中危(Medium)",
    "low": "低危(Low)", "safe": "安全(Safe)", "pending": "待研判(Pending)",
}
VERIFY_LABELS = {
    "verified_clean": "已修复/已清除", "verified_failed": "未修复/仍存留",
    "unverified": "未复测", "error": "复测异常",
}
TICKET_RISK_LABELS = {
    "critical": "极危", "high": "高危", "medium": "中危", "low": "低危", "safe": "安全",
}
TICKET_VERIFY_LABELS = {
    "unverified": "待复测 (未完成)", "verified_failed": "未修复 (风险仍残留)",
    "verified_clean": "已修复 (外链已清除)", "page_removed": "已下线 (页面404/删除)",
    "error": "访问异常 (超时/无法连接)",
}
YES, NO = "是", "否"

# --- fixed values: export headers ---
DOMAIN_HEADER = ["域名", "根域名", "出现频次", "风险等级", "风险标签", "研判说明", "闭环复测状态", "复测时间",
                 "包含链接属性", "包含文本/代码", "示例页面URL", "发现时间"]
SUBDOMAIN_HEADER = ["子域名", "根域名", "出现频次", "包含链接属性", "包含文本/代码", "示例页面URL", "发现时间"]
EVIDENCE_HEADER = ["外部域名", "任务ID", "任务名称", "目标站点", "证据来源属性", "发现页面URL", "匹配原始字符串",
                   "上下文代码片段", "记录时间"]
GLOBAL_HEADER = ["外部域名(FQDN)", "主根域名(Root)", "风险等级", "风险标签", "研判说明", "闭环验证状态", "验证时间",
                 "全局出现总频次", "覆盖任务数", "包含链接属性", "包含文本代码", "首次发现时间", "最近发现时间",
                 "示例页面URL", "关联任务概要"]
CROSS_TASK_HEADER = ["外部域名", "主根域名", "关联任务ID", "任务名称", "目标站点URL", "任务状态", "任务内频次",
                     "包含链接属性", "包含文本代码", "示例来源页面", "证据来源类型", "证据页面URL", "匹配原始串",
                     "上下文代码片段", "发现时间"]
TICKET_HEADER = ["工单序号", "所属任务ID", "所属任务名称", "被测站点入口", "涉险页面完整URL", "涉险页面标题",
                 "违规外链域名", "主根域名", "风险等级", "风险标签", "研判说明", "外链代码载体",
                 "源代码存证切片/位置片段", "复测闭环状态", "最近复测时间", "复测检测结论", "人工处置状态",
                 "处置建议及整改指引"]
PAGE_HEADER = ["ID", "URL", "Path", "Depth", "Status Code", "Title", "Crawled At"]
SITEMAP_HEADER = ['<?xml version="1.0" encoding="UTF-8"?>',
                  '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">']
SITEMAP_FOOTER = ["</urlset>"]
RULE_FILE_HEADER = [
    "# 风险情报规则库导出文件",
    "# 格式规范: 域名,风险等级,分类,标签(斜杠/分隔),备注说明",
    "# 风险等级支持: critical(严重), high(高危), medium(中危), low(低危), safe(官方安全)",
    "# 规则通配说明: 以 *. 开头表示主根域名通配 (*.domain.com)，无 *. 表示精确子域名匹配",
    "# 本文件可直接在「批量导入」界面中粘贴导入或直接选择文件导入",
]
TASK_NAME_SUFFIX = "_扫描"
TASK_SUMMARY = "{0} (ID:{1}, {2}次)"

# --- fixed values: remediation guides, first matching source type wins; {0} is the domain ---
GUIDE_SCRIPT = ("【静态脚本/JS代码排查】\n"
                "1. 打开涉险页面源码或引用的 JS 资源，查找包含 '{0}' 的外部引入或链接。\n"
                "2. 若属于被篡改植入或失效废弃的第三方库代码，请直接删除引用，或下载安全版本置于本单位服务器本地加载。\n"
                "3. 部署后更新前端缓存，确保页面外呼已切断。")
GUIDE_IFRAME = ("【暗链/Frame植入排查】\n"
                "1. 页面中存在指向 '{0}' 的 <iframe> 嵌入框架，极可能是暗链或恶意劫持投放。\n"
                "2. 请立即登录网站后台或直接编辑网页模板，删除涉嫌违规的 iframe 标签。\n"
                "3. 建议对该网页管理权限进行密码重置与安全加固。")
GUIDE_IMAGE = ("【外链图片排查】\n"
               "1. 页面中直接引用了指向 '{0}' 的外部图片链接。\n"
               "2. 请将所需图片下载并转存至本单位自建附件库/静态资源服务器，修改 <img> 标签 src 属性。\n"
               "3. 避免依赖不可控的第三方域名提供图床。")
GUIDE_LINK = ("【超链接处置建议】\n"
              "1. 登录网站内容管理系统(CMS)，找到本页面的正文或导航栏。\n"
              "2. 查找并删除指向 '{0}' 的 <a> 锚点超链接；若为必要引用，请核实其目标地址并替换为官方或权威链接。\n"
              "3. 保存发布后，点击系统中的【重新校验】验证清除结果。")
GUIDE_OTHER = ("【综合处置建议】\n"
               "1. 检查页面 HTML 及内嵌资源中对 '{0}' 的引用并予以清除。\n"
               "2. 若该页面为陈旧历史通知或无用测试页面，建议直接在 Web 服务器中将该页面删除并配置 404/410 状态码下线。")

# --- fixed values: preset tags with their default level ---
PRESET_TAGS = [
    ("黑灰产威胁", "黑产博彩", "critical"), ("黑灰产威胁", "暗链挂马", "critical"),
    ("黑灰产威胁", "低俗色情", "critical"), ("黑灰产威胁", "恶意欺诈", "critical"),
    ("黑灰产威胁", "钓鱼盗号", "critical"), ("黑灰产威胁", "仿冒涉诈", "critical"),
    ("黑灰产威胁", "恶意C2", "critical"), ("黑灰产威胁", "挖矿脚本", "critical"),
    ("违规引流", "广告引流", "high"), ("违规引流", "纯IP外链", "medium"),
    ("违规引流", "短链跳转", "medium"), ("违规引流", "恶意重定向", "high"),
    ("违规引流", "未备案外链", "medium"), ("违规引流", "快照镜像", "medium"),
    ("失效异常", "失效废弃", "medium"), ("失效异常", "死链404", "low"),
    ("失效异常", "域名抢注劫持", "high"), ("失效异常", "DNS解析失败", "low"),
    ("官方安全", "官方合作", "safe"), ("官方安全", "政务站群", "safe"),
    ("官方安全", "公共静态CDN", "safe"), ("官方安全", "云存储服务", "safe"),
    ("官方安全", "社交分享", "safe"), ("官方安全", "统计分析", "safe"),
    ("官方安全", "地图与字体", "safe"), ("官方安全", "支付结算", "safe"),
]


# Named character references that are decoded, the ampersand last
NAMED_REFERENCES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("colon", ":"), ("sol", "/"), ("period", "."), ("quest", "?"),
    ("equals", "="), ("num", "#"), ("commat", "@"), ("lowbar", "_"), ("hyphen", "\u2010"), ("amp", "&"),
]
