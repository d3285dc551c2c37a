"""Reference lists by example, and in linear time."""

import time

import pytest

from folioscope.operators import bibliography

NUMBERED = """
      References
      [12] Jane Doe. 2024. A Memory Retrieval Paper. KDD.
      Gyubok Lee, Hyeonji Hwang, and Edward Choi. 2022. EHRSQL: A practical text-to-SQL benchmark. NeurIPS.
    """
YEAR_LAST = """
      DPO-14B MedCopilot-14B (GRPO) Figure 16 qualitative comparison.
      R EFERENCES
      Daya Guo, Dejian Yang, Haowei Zhang, Junxiao Song, Ruoyu Zhang, Runxin Xu,
      Qihao Zhu, Shirong Ma, Peiyi Wang, Xiao Bi, et al. Deepseek-r1: Incentivizing
      reasoning capability in llms via reinforcement learning. arXiv preprint
      arXiv:2501.12948, 2025.
      Siyuan Guo, Cheng Deng, Ying Wen, Hechang Chen, Yi Chang, and Jun Wang.
      DS-agent: Automated data science by empowering large language models with
      case-based reasoning. ICML, 2024.
      A L IMITATIONS AND B ROADER I MPACTS
      DeepSeek-R1 (Guo et al., 2025). DPO-14B MedCopilot-14B GRPO Figure 16.
    """
INITIALS = "References [3] Quoc V. Le. Massive exploration of neural machine translation architectures. CoRR, 2017. [9] Yann N. Dauphin. Convolutional sequence to sequence learning. arXiv, 2017. [19] Alexander M. Rush. Structured attention networks. ICLR, 2017."
SEVERAL = " ".join([
    "Online content Any methods, additional references and statements are available online.",
    "References 1. Ehrenfeld, J. M. & Cannesson, M. (eds) Monitoring Technologies in Acute Care Environments (Springer Science & Business Media, 2013).",
    "7. Wallace, D. J., Angus, D. C. & Kahn, J. M. Nighttime intensivist staffing and mortality among critically ill patients. N. Engl. J. Med. 366 , 2093–2101 (2012). quiz 35.",
    "18. Dietterich, T. G. in Joint IAPR International Workshops on Statistical Techniques in Pattern Recognition vol. 2396 15–30 (Springer, 2002).",
    "Publisher’s note Springer Nature remains neutral with regard to jurisdictional claims.",
    "Methods Study design and setting. Patients admitted before 2008 were excluded from the analysis due to frequent changes in variable identifiers.",
    "References 59. Ye, L. & Keogh, E. in Proceedings of the 15th ACM SIGKDD International Conference on Knowledge Discovery and Data Mining 947–956 (ACM, 2009).",
    "60. Bock, C. et al. Association mapping in biomedical time series via statistically significant shapelet mining. Bioinformatics 34 , i438–i446 (2018).",
    "a cknowledgements Funding for this work was provided by the Swiss National Science Foundation. S.L.H. and T.G. with input from all authors created Fig. 1. Competing interests The authors declare no competing interests.",
])


@pytest.fixture(scope="module")
def read(spark):
    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "paper long, text string")
        out = {k: {} for k in range(len(texts))}
        for r in bibliography.references(df, "paper", "text").collect():
            assert r.key not in out[r.paper]
            out[r.paper][r.key] = r
        return out

    return run


def test_lists(read):
    forty = "References " + " ".join(f"[{k}] Author {k}. 2017. Paper {k} with a stable title. Venue." for k in range(1, 41))
    prose = "References 1. Author, A. A stable paper title. Journal 1 , 1–2 (2019). " + "This sentence is prose that follows the final reference of the list. " * 40
    caption = "References [1] Author One and Author Two. A stable paper title. Journal, 2013. 12 Figure 3: unrelated caption text."
    got = read(NUMBERED, YEAR_LAST, forty, caption, INITIALS, SEVERAL, prose, "No list. 2020.", "", None, "References")
    assert "Memory Retrieval" in got[0]["12"].title and "EHRSQL" in got[0]["lee-2022"].title and got[0]["lee-2022"].year == 2022
    assert "Deepseek-r1" in got[1]["guo-2025"].title and "Figure 16" not in got[1]["guo-2025"].title and sum(r.year == 2025 for r in got[1].values()) == 1
    assert got[1]["guo-2024"].authors.endswith("Jun Wang") and got[1]["guo-2024"].venue == "ICML"
    assert len(got[2]) == 40 and got[2]["40"].year == 2017 and got[2]["40"].authors == "Author 40" and got[2]["40"].venue == "Venue"
    assert (got[3]["1"].title, got[3]["1"].year) == ("A stable paper title", 2013)
    assert [got[4][k].title for k in ("3", "9", "19")] == ["Massive exploration of neural machine translation architectures", "Convolutional sequence to sequence learning", "Structured attention networks"]
    assert len(got[6]["1"].raw) < 1000 and len(got[6]["1"].authors) < 200
    assert not any(got[k] for k in (7, 8, 9, 10))


def test_several_lists_up_to_the_back_matter(read):
    got = read(SEVERAL)[0]
    assert sorted(got) == ["1", "18", "59", "60", "7"]
    of = lambda k: (got[k].authors, got[k].title, got[k].year)
    assert of("1") == ("Ehrenfeld, J. M. & Cannesson, M", "Monitoring Technologies in Acute Care Environments", 2013)
    assert of("7") == ("Wallace, D. J., Angus, D. C. & Kahn, J. M", "Nighttime intensivist staffing and mortality among critically ill patients", 2012)
    assert got["7"].venue == "N. Engl. J. Med. 366 , 2093–2101"
    assert of("18") == ("Dietterich, T. G", "Joint IAPR International Workshops on Statistical Techniques in Pattern Recognition", 2002)
    assert of("59") == ("Ye, L. & Keogh, E", "Proceedings of the 15th ACM SIGKDD International Conference on Knowledge Discovery and Data Mining", 2009)
    assert of("60") == ("Bock, C. et al", "Association mapping in biomedical time series via statistically significant shapelet mining", 2018)


def test_long_lists_take_linear_time(read):
    unfinished = "Researcher Name. Reliable clinical agent benchmark with reproducible evaluation details and no terminal publication year. "
    took = []
    for n in (700, 700, 7000):
        began = time.time()
        assert read("R EFERENCES\n" + unfinished * n) == {0: {}}
        took.append(time.time() - began)
    assert took[2] < 10 * took[1] + 5
