"""The small labelled table that the personal-data tagger is trained on.

No sentence, street, shop or topic in it is taken from any corpus. Ordinary words are syllables
made by rule from the onsets, rimes and tones of Vietnamese, so a tagger can learn little from
words themselves and must go by shapes, by closed word classes (family names, titles, words
before numbers) and by neighbours. The made syllables and the lists of given names and streets
are each cut into two halves by a hash: `train` sentences only use the one, `held` sentences only
the other, so accuracy on `held` is measured on words that were never seen.
"""

from __future__ import annotations

import random
import unicodedata
import zlib
from functools import cache

KINDS = ("email", "phone", "id_number", "address", "name")

# Vietnamese family names, frequent ones and rare ones.
FAMILY = (
    "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Mai Trịnh Đào Lương Tô Tạ Phùng Hà Cao Thái Chu Châu Quách La Lâm "
    "Tăng Triệu Lưu Vương Kiều Diệp Doãn Khuất Nghiêm Giáp Ninh Kim Viên Cấn Ngạc Tòng Lường Quàng Lều Bế Chế Danh Thạch Thân Ông Ma Lò Cầm Hứa Mạc "
    "Nông Đoàn Từ Tống Trương Văn Âu Cù Ung Khổng Lộc Sầm Vi Đàm Thẩm Bạch Giang Hầu Khương Lại Mã Nhữ Phó Quản Tiêu Trà Vòng Xa Đồng Điêu Tôn Thi Lục Nghị Quan Phí Hàn Bàng Cung Đường Khúc Liễu Mẫn Nhâm Ôn Sơn Sử Thang Thiều Ưng Yên"
).split()
# Frequent middle and given names.
MIDDLE = "Văn Thị Đình Hữu Đức Ngọc Minh Quang Xuân Thanh Bá Công Gia Hoàng Khánh Mạnh Quốc Thành Tuấn Thu Thùy Kim Bảo Anh".split()
GIVEN = (
    "An Anh Ánh Ân Bảo Bách Bích Bình Chi Chính Chung Cúc Cường Cương Dân Diễm Diệu Dung Dũng Duy Duyên Dương Đạt Đăng Đào Điệp Đông Đức Giang Giáp Hà Hai Hải Hạnh Hân Hằng Hậu Hiên Hiền Hiển Hiệp Hiếu "
    "Hoa Hòa Hoài Hoàn Hoàng Hồng Huệ Huân Hùng Huy Huyền Hương Hường Hưng Kha Khang Khánh Khoa Khôi Khuê Kiên Kiệt Kim Lam Lan Lâm Lân Lệ Liên Liễu Linh Loan Long Lộc Lợi Luân Luyến Lực Ly Mai Mạnh Mẫn Mây Minh "
    "My Mỹ Nam Nga Ngân Nghĩa Ngọc Nguyên Nguyệt Nhàn Nhân Nhật Nhi Nhung Như Oanh Phát Phi Phong Phú Phúc Phụng Phước Phương Phượng Quang Quân Quế Quốc Quý Quyên Quyền Quỳnh Sang Sáng Sinh Sơn Sương Tài Tâm Tân "
    "Tấn Thạch Thái Thanh Thành Thảo Thắm Thắng Thế Thi Thiện Thịnh Thoa Thơ Thơm Thu Thúy Thùy Thủy Thư Thương Tiên Tiến Tín Tình Toàn Trà Trang Trâm Trí Trinh Trọng Trung Trúc Trường Tú Tuấn Tuệ Tùng Tuyến Tuyết Uyên Vân Vi Viên Việt Vinh Vũ Vy Xuân Yên Yến"
).split()
# Well-known street names of Vietnamese cities.
STREETS = (
    "Lê Lợi|Trần Phú|Nguyễn Trãi|Hai Bà Trưng|Lý Thường Kiệt|Quang Trung|Điện Biên Phủ|Nguyễn Huệ|Hùng Vương|Trần Hưng Đạo|Bà Triệu|Giải Phóng|Lê Duẩn|Kim Mã|Xuân Thủy|Cách Mạng Tháng Tám|"
    "Phạm Văn Đồng|Tôn Đức Thắng|Hoàng Diệu|Phan Đình Phùng|Ngô Quyền|Lý Tự Trọng|Võ Thị Sáu|Nguyễn Du|Hàm Nghi|Lạc Long Quân|Âu Cơ|Thái Hà|Đội Cấn|Chùa Bộc|Tây Sơn|Trường Chinh"
).split("|")
DIGITS = "không một hai ba bốn năm sáu bảy tám chín".split()
# Frequent function words.
COMMON = (
    "là thì mà của và có không được cho với này kia rất quá nhưng nếu khi đã đang sẽ vẫn cũng còn hay hoặc để từ trong ngoài trên dưới ở tại về đến tới vì nên bị do như cái con người ai gì nào đâu sao thế vậy rồi "
    "mình em tôi bạn anh chị các những mấy một hai ba nhiều ít hơn lắm nhất mới lại đi ra vào lên xuống làm thấy biết nói xem học ăn mua bán chờ giúp xin nhé nha ạ ơi đây đó kìa luôn chỉ đều cả theo qua sau trước"
).split()
# Words that go before a thing's name, and words that go before a code or count.
THINGS = "quán|tiệm|shop|clb|CLB|hội|đội|tổ|nhóm|lớp|trường|chợ|hãng|hiệu|nhà|sân|khu|xóm|phòng|ban|xưởng|phim|bài|sách|cầu|hồ|sông|làng|chùa|công ty|dự án|gian hàng|cửa hàng|thương hiệu|đội bóng|ban nhạc|câu lạc bộ|quán ăn|quán cà phê|phòng trà|tòa nhà|bến|ga".split("|")
MAIL_ENDS = "com vn net org edu.vn com.vn example test invalid example.com example.org".split()
MAIL_HOSTS = "gmail yahoo outlook hotmail mail icloud".split()
CUES = "hỏi gặp gửi nhờ nhắn gọi số liên hệ địa chỉ tên mail nhà đường phố giao đến chủ viên".split()
TITLES = "anh chị cô thầy bạn bác chú ông bà em dì cậu".split()
EMOJI = "😊 👍 😢 ❤️ 🙏 🥲 😡 🎉".split()

# The parts that Vietnamese syllables are made of.
ONSETS = "- b c ch d đ g gi h kh l m n nh ng ph qu r s t th tr v x".split()
RIMES = (
    "a ai ao au am an ang anh ac at ap ach ay âu ây âm ân âng âc ât âp ăm ăn ăng ăc ăt ăp e eo em en ec et ep ê êu êm ên ênh êt êp êch i iu im in inh ich it ip ia iêu iêm iên iêng iêc iêt iêp "
    "o oi om on ong oc ot op oa oai oan oang oat oay ô ôi ôm ôn ông ôc ôt ôp ơ ơi ơm ơn ơt ơp u ui um un ung uc ut up ua uân uât uê uôi uôm uôn uông uôc uôt uy uyên uyêt ư ưi ưm ưng ưc ưt ưa ươi ươm ươn ương ươc ươt ươp ưu"
).split()
TONES = ["", "̀", "́", "̃", "̉", "̣"]


def bare(s: str) -> str:
    """Without accents, đ as d."""
    s = unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in s if not unicodedata.combining(c))


def held_out(word: str) -> bool:
    """Whether a word belongs to the half that is never trained on."""
    return zlib.crc32(bare(word.lower()).encode()) & 1 == 1


@cache
def syllables(held: bool) -> list[str]:
    """All onsets with all rimes and tones of one half; a tone stands on the rime's main vowel."""
    out = []
    for onset in ONSETS:
        for rime in RIMES:
            stops = rime[-1] in "ctp" or rime.endswith("ch")
            vowels = [i for i, ch in enumerate(rime) if bare(ch) in "aeiouy"]
            marked = [i for i in vowels if ch_marked(rime[i])]
            at = marked[-1] if marked else vowels[1] if len(vowels) > 1 and vowels[-1] != len(rime) - 1 else vowels[0]
            for tone in ("́", "̣") if stops else TONES:
                out.append(unicodedata.normalize("NFC", onset.replace("-", "") + rime[: at + 1] + tone + rime[at + 1 :]))
    return sorted({s for s in out if held_out(s) == held})


def ch_marked(ch: str) -> bool:
    return bare(ch) != ch


class _Writer:
    def __init__(self, seed: int, held: bool):
        self.r = random.Random(seed)
        half = lambda xs: [x for x in xs if held_out(x) == held]
        self.syllables, self.given, self.streets = syllables(held), half(GIVEN), half(STREETS)
        self.family_low = [f.lower() for f in FAMILY]

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        roll = self.r.random()
        return self.pick(COMMON) if roll < 0.3 else self.pick(self.family_low) if roll < 0.42 else self.pick(self.given).lower() if roll < 0.46 else self.pick(CUES) if roll < 0.49 else self.pick(self.syllables)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def proper(self, low: int = 1, high: int = 3) -> str:
        """The made name of a street or a thing, sometimes like a person's."""
        if self.r.random() < 0.3:
            return f"{self.pick(FAMILY)} {self.pick(self.given)}"
        return " ".join(self.pick(self.syllables).title() if self.r.random() < 0.85 else self.pick(self.given + FAMILY) for _ in range(self.r.randint(low, high)))

    def latin(self) -> str:
        return bare(self.pick(self.syllables))

    def code(self) -> str:
        r, up = self.r, lambda n: "".join(self.pick("ABCDEGHKLMNPQSTVX") for _ in range(n))
        return self.pick([
            lambda: f"phòng {self.pick('ABCDEH')}{r.randint(1, 9)}-{r.randint(100, 999)}", lambda: f"phòng {r.randint(101, 909)}", lambda: f"lớp {up(1)}{r.randint(15, 26)}-{r.randint(0, 99):02d}", lambda: f"lớp {up(1)}{r.randint(15, 26)}{up(4)}{r.randint(1, 19):02d}",
            lambda: f"{r.randint(5, 900)}k", lambda: f"{r.randint(7, 22)}h{r.randint(0, 59):02d}", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/20{r.randint(20, 27)}", lambda: f"mã {r.randint(100, 99999)}",
            lambda: f"phiếu {r.randint(100, 9999)}", lambda: f"phiếu: {r.randint(100, 9999)}", lambda: f"tầng {r.randint(1, 20)} nhà {up(1)}", lambda: f"{r.randint(1, 99)} {self.word()}", lambda: f"lúc {r.randint(7, 22)} giờ", lambda: f"tuần {r.randint(1, 20)}", lambda: f"khóa {r.randint(10, 30)}",
        ])()

    def decoy(self) -> str:
        """What looks like personal data and is none."""
        r, up = self.r, lambda n: "".join(self.pick("ABCDEGHKLMNPQSTVX") for _ in range(n))
        about = self.pick(["mã đơn", "mã giao dịch", "đơn hàng", "mã vận đơn", "hóa đơn", "mã hồ sơ", "số hợp đồng", "mã phiếu", "biên lai", "mã đặt chỗ", "mã đơn hàng", "mã yêu cầu", "số seri"])
        number = lambda: f"{r.randint(1, 9)}{self.digits(r.randint(4, 15))}"
        return self.pick([
            lambda: f"{about} {number()}", lambda: f"{about} {number()}", lambda: f"{about} #{number()}", lambda: f"{about}: {number()}", lambda: f"{about} số {number()}", lambda: f"#{number()}",
            lambda: f"giá {r.randint(1, 99)}.{self.digits(3)}.000đ", lambda: f"{r.randint(10, 999)}.000 đồng", lambda: f"ngày {r.randint(1, 28):02d}-{r.randint(1, 12):02d}-20{r.randint(20, 27)}", lambda: f"20{r.randint(20, 27)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            lambda: f"điểm {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"bản v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}", lambda: f"môn {up(2)}{self.digits(4)}", lambda: f"mã môn {up(3)}{self.digits(self.pick([3, 4]))}", lambda: f"học phần {up(2)}{self.digits(4)}",
            lambda: f"https://{self.latin()}-{r.randint(1, 9)}.{self.pick(MAIL_ENDS)}/{self.latin()}/{self.digits(8)}", lambda: f"www.{self.latin()}{r.randint(1, 9)}.{self.pick(MAIL_ENDS)}/{self.latin()}", lambda: f"xem {self.latin()}.{self.pick(MAIL_ENDS)}",
            lambda: f"@{self.latin()}.{r.randint(1, 9)}k", lambda: f"@{self.latin()}_{self.latin()}", lambda: f"@{self.latin()}{self.digits(3)}", lambda: f"{self.pick(['ngõ', 'đường', 'phố', 'hẻm'])} nào {self.words(1, 3)}", lambda: f"{self.pick(['đường', 'phố'])} {self.pick([*self.streets, self.proper()])} {self.words(1, 3)}",
            lambda: f"câu số {r.randint(1, 40)}", lambda: f"chương {r.randint(1, 9)}.{r.randint(1, 9)}", lambda: f"số báo danh {r.randint(1, 400)}", lambda: f"mục {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}", lambda: f"tổ {r.randint(1, 9)} {self.words(1, 3)}", lambda: f"số {r.randint(1, 99)} {self.words(1, 2)}",
            lambda: f"{r.randint(10, 31)} {r.randint(1, 12)} phòng {up(1)}{r.randint(1, 4)} {r.randint(100, 599)}", lambda: f"lớp {up(1).lower()}{r.randint(15, 26)} {r.randint(0, 59):02d}",
        ])()

    def thing(self) -> str:
        """A named shop, club, place or work."""
        return f"{self.pick(THINGS)} {self.proper(1, 3)}"

    def carrier(self) -> str:
        r = self.r
        s = self.pick([
            lambda: f"{self.words(2, 6)} {self.code()} {self.words(1, 5)}", lambda: f"{self.words(2, 7)} {self.code()}", lambda: self.words(3, 10), lambda: self.words(3, 10), lambda: f"{self.words(1, 4)} {self.thing()} {self.words(1, 5)}", lambda: f"{self.thing()} {self.words(2, 6)}",
            lambda: f"{self.words(2, 5)}, {self.words(2, 5)}, {self.thing()} {self.words(1, 3)}", lambda: f"{self.words(1, 2)}: {self.words(2, 4)}; {self.pick(['Nhóm', 'Đội', 'Lớp', 'Phòng', 'Ca'])}: {self.proper(2, 2)}; {self.words(1, 2)}: {self.words(1, 4)}", lambda: f"{self.words(2, 4)} {self.code()} {self.thing()}",
        ])()
        how = r.random()
        if how < 0.07:
            s = s.upper()
        elif how < 0.15:
            s = s.title()
        elif how < 0.25:
            s = bare(s)
        elif how < 0.32:
            s = s.lower()
        elif how < 0.55:
            s = s[0].upper() + s[1:]
        return s

    # personal data: (before, value, after)
    def email(self):
        r = self.r
        local = self.pick([
            lambda: self.latin() + self.pick(["", ".", "_", "-"]) + self.latin() + self.pick(["", "", str(r.randint(0, 9999)), f"+{self.latin()}", f"+{r.randint(0, 9)}{self.latin()}"]),
            lambda: self.latin() + self.digits(r.randint(1, 4)),
        ])()
        host = self.pick([*MAIL_HOSTS, self.latin(), f"{self.latin()}-{self.latin()}", f"{self.latin()}.{self.latin()}", f"{self.latin()}{r.randint(1, 9)}"])
        domain = f"{host}.{self.pick(MAIL_ENDS)}"
        at, dot = self.pick([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" a còng ", " chấm "), (" a cong ", " cham "), ("[at]", "[dot]"), (" at ", ".")])
        v = local + at + domain.replace(".", dot)
        v = v.upper() if r.random() < 0.1 else v
        return self.pick(["mail ", "email ", "email: ", "e-mail ", "gửi ", "thư ", "hộp thư ", "liên hệ ", "địa chỉ mail ", "mailto:", "mail mailto:", f"{self.words(1, 4)} ", "", "", "qua "]), v, self.pick(["", "", " " + self.word(), " nhé"])

    def phone(self):
        r = self.r
        n = "0" + self.pick("35789") + self.digits(8)
        spoken = " ".join(DIGITS[int(c)] for c in n)
        cut = lambda a, b, sep: sep.join([n[:a], n[a:b], n[b:]])
        v = self.pick([
            lambda: n, lambda: n, lambda: n, lambda: cut(4, 7, " "), lambda: cut(4, 7, "."), lambda: cut(4, 7, "-"), lambda: cut(3, 6, " "), lambda: cut(3, 6, "."), lambda: f"{n[:2]} {n[2:4]} {n[4:6]} {n[6:8]} {n[8:]}", lambda: f"{n[:3]} {n[3:6]} {n[6:8]} {n[8:]}",
            lambda: f"+84{n[1:]}", lambda: f"84{n[1:]}", lambda: f"+84 {n[1:4]} {n[4:7]} {n[7:]}", lambda: f"(+84) {n[1:4]}-{n[4:]}", lambda: f"(+84) {n[1:]}", lambda: f"+84-{n[1:4]}-{n[4:7]}-{n[7:]}", lambda: f"({n[:4]}) {n[4:7]} {n[7:]}",
            lambda: n.replace("0", "o"), lambda: n.replace("0", "O", 1), lambda: spoken, lambda: spoken, lambda: bare(spoken), lambda: spoken.upper(), lambda: f"02{self.pick('48')}{self.digits(8)}",
        ])()
        before = self.pick(["sđt ", "sđt: ", "đt ", "gọi ", "alo ", "alo số ", "lh ", "liên hệ ", "zalo ", "hotline ", "điện thoại ", "điện thoại: ", "số ", "số điện thoại ", "tel ", "nhắn ", "call ", "", "", "", f"{self.words(1, 4)} "])
        return before, v, self.pick(["", "", " gặp em", " nha", " " + self.word(), " " + self.words(2, 3)])

    def id_number(self):
        r = self.r
        nine, twelve = self.digits(9), "0" + self.digits(11)
        letters = lambda n: "".join(self.pick("ABCDEGHIJKLMNPQRSTUVXYZ") for _ in range(n))
        sep = self.pick(["", "", "", "-", ".", " "])
        code = self.pick([f"{letters(1)}{r.randint(15, 26)}{letters(4)}{self.digits(3)}", f"{self.pick(['SV', 'HV', letters(2)])}{r.randint(15, 26)}{sep}{letters(2)}{sep}{self.digits(4)}"])
        code = code.lower() if r.random() < 0.25 else code
        group = lambda s, n, c: c.join(s[i : i + n] for i in range(0, len(s), n))
        before, v = self.pick([
            ("cmnd ", nine), ("CMND: ", group(nine, 3, ".")), ("số cmnd ", group(nine, 3, " ")), ("chứng minh thư ", group(nine, 3, " ")), ("chứng minh nhân dân ", nine), ("cccd ", twelve), ("CCCD: ", group(twelve, 4, ".")), ("số định danh ", twelve), ("căn cước ", group(twelve, 3, " ")), ("căn cước số ", group(twelve, 3, " ")), ("số căn cước ", twelve),
            ("mssv ", code), ("MSSV: ", code), ("mã sv ", code), ("mã sinh viên ", code), ("mã số sinh viên ", code), ("", code), ("", code), (f"{self.words(1, 3)} ", code), (f"{self.words(1, 3)} ", code),
        ])
        before = bare(before) if r.random() < 0.12 else before
        return self.pick(["", "", "", f"{self.words(1, 3)} "]) + before, v, self.pick(["", "", "", " " + self.words(1, 2)])

    def address(self):
        r = self.r
        street, ward = self.pick([*self.streets, *[self.proper(1, 4) for _ in range(60)]]), self.pick([self.proper(1, 2), self.proper(2, 2), str(r.randint(1, 18))])
        n = self.pick([str(r.randint(1, 999)), f"{r.randint(1, 299)}{self.pick('ABC')}", f"{r.randint(1, 99)}/{r.randint(1, 299)}", f"{r.randint(1, 99)}/{r.randint(1, 9)}/{r.randint(1, 9)}"])
        road, quarter = self.pick(["đường", "phố", "đường", "phố", "đ."]), self.pick(["phường", "phường", "P.", "p.", "quận", "xã", "Q."])
        tail = self.pick(["", f", {quarter} {ward}", f", {quarter} {ward}", f" {quarter} {ward}", f" {quarter}{ward}" if quarter.endswith(".") else ""])
        v = self.pick([
            lambda: f"số {n} {road} {street}{tail}", lambda: f"số nhà {n}, {road} {street}{tail}", lambda: f"{n} {road} {street}{tail}", lambda: f"{n} {street}, {quarter} {ward}", lambda: f"{n} {street}, {quarter} {ward}", lambda: f"{n} {self.proper(2, 4)}, {quarter} {ward}", lambda: f"nhà {n} {self.pick(['ngõ', 'hẻm', 'ngách', 'kiệt'])} {r.randint(1, 99)} {road} {street}{tail}", lambda: f"số {n} ngõ {r.randint(1, 299)} {road} {street}{tail}",
            lambda: f"ngách {r.randint(1, 99)}/{r.randint(1, 99)} {road} {street}{tail}", lambda: f"SN {n}, tổ {r.randint(1, 90)}, {quarter} {ward}", lambda: f"số {n}, tổ {r.randint(1, 40)}, phường {ward}", lambda: f"nhà {n} hẻm {r.randint(1, 99)}/{r.randint(1, 9)} {road} {street}{tail}", lambda: f"nhà số {n} ngõ {r.randint(1, 99)} {street}{tail}", lambda: f"số {n}, thôn {ward}, xã {self.proper(1, 2)}",
        ])()
        how = r.random()
        v = v.lower() if how < 0.3 else v.upper() if how < 0.34 else bare(v) if how < 0.42 else bare(v).lower() if how < 0.48 else v
        before = self.pick(["địa chỉ ", "địa chỉ: ", "giao ", "giao tới ", "ship ", "ship tới ", "ở ", "nhà ở ", "ghé ", "trọ ở ", "gửi về ", "đến ", "", "", f"{self.words(1, 4)} ", "tại "])
        return before, v, self.pick(["", "", " nhé", " giúp", " " + self.words(1, 3)])

    def name(self):
        r = self.r
        middle = [self.pick(MIDDLE)] if r.random() < 0.35 else []
        how, known = r.random(), r.random() < 0.6
        given = [self.pick(self.given) if known else self.pick(self.syllables).title() for _ in range(r.choice([1, 1, 1, 2]))]
        v = " ".join([self.pick(FAMILY), *middle, *given])
        v = v.upper() if how < 0.12 else v.lower() if how < 0.3 else bare(v) if how < 0.43 else bare(v).lower() if how < 0.5 else v
        title = self.pick(TITLES) + " "
        strong = [(title, ""), (title, f" {self.words(1, 4)}"), (title, f" {self.words(1, 4)}"), (title, " ơi"), ("", " ơi"), ("", f" ơi {self.words(1, 4)}"), ("em tên là ", ""), ("tên là ", ""), ("họ tên: ", ""), ("mình là ", ""), ("mình là ", " đây"), ("tôi tên ", ""), ("chủ nhà ", ""), ("giảng viên ", ""), ("người nhận ", ""), ("gửi ", " giúp")]
        weak = [("tên ", ""), ("tôi là ", f" {self.words(1, 3)}"), ("sinh viên ", ""), ("gặp ", f" {self.words(1, 3)}"), ("cảm ơn ", ""), ("hỏi ", f" {self.words(1, 3)}")]
        before, after = self.pick(strong if v.islower() else strong + weak)
        return self.pick(["", "", "nhờ ", "nhắn ", "hỏi ", f"{self.words(1, 3)} "]) + before, v, after

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        text, spans = "", []
        for k in range(r.randint(2, 6)):
            if k:
                text += self.pick([". ", ", ", " - ", " ", "! ", "... ", "? ", "\n", " "])
            roll = r.random()
            if roll < 0.42:
                text += self.carrier()
            elif roll < 0.58:
                text += self.decoy()
            elif roll < 0.61:
                text += self.pick(EMOJI)
            else:
                before, value, after = getattr(self, kind := self.pick(KINDS))()
                wrap = kind == "id_number" and r.random() < 0.25
                text += ("(" if wrap else "") + before
                spans.append((len(text), len(text) + len(value), kind))
                text += value + after + (")" if wrap else "")
        return text + self.pick(["", "", "!", ".", " nhé", " 👍"]), spans


def labelled_table(n: int, seed: int, held: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n sentences with the (start, end, kind) of the personal data in each, from the words of the trained or of the held-out half."""
    w = _Writer(seed, held)
    return [w.sentence() for _ in range(n)]
