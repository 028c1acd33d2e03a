"""Fixed values shared by Spark and by the SQL of the checks: both engines read these patterns alike."""

#: What str.isspace calls white space.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same without the line feed.
INLINE = r"\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Ranges of scripts.
SCRIPTS = {
    "zh": r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}",
    "mongolian": r"\x{1800}-\x{18af}\x{11660}-\x{1167f}",
    "cyrillic": r"\x{400}-\x{4ff}\x{500}-\x{52f}\x{2de0}-\x{2dff}\x{a640}-\x{a69f}",
    "latin": r"A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{100}-\x{24f}",
    "cjk": r"\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}",
    "mn": r"\x{1800}-\x{18af}\x{11660}-\x{1167f}\x{202f}",
}
#: Scripts whose characters are words of their own.
WORDLESS = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}"
TOKEN = f"[{WORDLESS}]|[^{SPACE}{WORDLESS}]+"
WORD = f"[^{SPACE}]+"
#: Symbols that count as junk.
JUNK = "[#…•·|►▶■□▪]"
#: Text whose presence marks boilerplate.
BOILERPLATE = ("京ICP备", "蒙ICP备", "版权所有", "All Rights Reserved", "未经授权")
#: Lines of web furniture.
WEB_LINES = (
    r"^.{0,12}声明[:：]", r"免责声明", r"版权所有", r"All Rights Reserved", r"未经.{0,6}(授权|许可|书面同意)", r"如遇作品内容.{0,4}版权",
    r"本(文|站|网|公众号).{0,8}(转载|来源|版权)", r"^责任编辑[:：]", r"^编辑[:：]", r"^来源[:：].{0,40}\z", r"^记者[:：].{0,30}\z",
    r"^(上一篇|下一篇|相关(阅读|推荐|新闻|链接))", r"(我要|发表|查看更多)?评论\s*\(?\d*\)?\z", r"(扫一扫|扫码).{0,12}(关注|下载|分享|二维码)",
    r"关注.{0,6}(公众号|微信|视频号)", r"微信(公众号|号)[:：]", r"阅读原文", r"分享到[:：]?", r"^(打印|收藏|点赞|转发|返回(顶部|列表))\z", r"网站地图",
    r"^字号[:：]", r"^\s*play\s+stop\s+mute", r"^(客服|投诉|举报|咨询|联系)?(热线|电话)[:：]", r"京ICP备|蒙ICP备|粤ICP备|沪ICP备|ICP备\d", r"公网安备",
)
WEB_LINE = "(?s)" + "|".join(WEB_LINES)
#: Spam.
SPAM_OFFER = "(代开|代办|出售|批发|收购|转让|办证|代孕|刷单|套现|网赚|私聊|微商|薇商|包邮购)"
SPAM_CONTACT = r"(微信|薇信|徽信|威信|QQ|扣扣|vx|VX|Vx|whatsapp|telegram|纸飞机)\s*[:：]?\s*[0-9A-Za-z][0-9A-Za-z\- ]{4,}"
SPAM_GAMBLING = "(六合彩|时时彩|私彩|百家乐|博彩|赌场|赌博|娱乐城|彩金|外围|菠菜平台)(?s).{0,12}(网址|平台|注册|开户|代理|官网|送|app|APP)"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}\x{2060}]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
#: Mongolian controls.
VARIATION_SELECTORS = "\u180b\u180c\u180d\u180f"
VOWEL_SEPARATOR = "\u180e"
NARROW_SPACE = "\u202f"
ZERO_WIDTH_NOISE = "\u200b\u200c\u200d\u2060\ufeff"
GRAPHEME = r"(?s).[\x{180b}-\x{180d}\x{180f}\p{M}]*"
#: Cleaning of Mongolian lines.
MONGOLIAN_SNIPPETS = (
    "Copyright", "All Rights Reserved", "版权所有", "蒙ICP备", "京ICP备", "ICP备", "未经授权", "ᠠᠭᠤᠯᠭ᠎ᠠ ᠨᠢ ᠰᠦᠯᠵᠢᠶ᠎ᠡ ᠡᠴᠡ ᠢᠷᠡᠯᠲᠡ",
    "ᠡᠷᠬᠡ ᠳᠦ ᠬᠠᠯᠳᠠᠭᠰᠠᠨ", "ᠪᠢᠳᠡ ᠲᠡᠷᠡ ᠳᠠᠷᠤᠢ ᠬᠠᠰᠤᠨ᠎ᠠ",
)
DECORATION = r"[ \t\n\r\x0b\x0c★☆*#=_\-—–·•|<>《》［\]\[（）()【】{}:：;；,.，。、!?！？~～]+"
HEADINGS = r"(?:ᠭᠠᠷᠴᠠᠭ|ᠲᠣᠳᠣᠷᠬᠠᠶᠢᠯᠠᠯᠲᠠ)[ \t]*(?:\(\)|（\）)?"
PAGE = r"#?[ \t]*page[ \t]*[-_#:]?[ \t]*\d+[ \t]*#?"
