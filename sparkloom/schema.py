"""Row types of the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions.shared import materialize

LINES = "struct<start:int,end:int>"
EVIDENCE = f"struct<span:string,path:string,lines:{LINES},kind:string>"
DOCS = "id string, title string, path string, url string"
SECTIONS = f"id string, doc_id string, doc_title string, heading string, level int, path string, lines {LINES}, url string, text string, code array<struct<path:string,raw_path:string,lines:{LINES},text:string>>, chars int"
CONCEPTS = "id string, label string, kind string, aliases array<string>, surface_forms array<string>"
QUESTIONS = "id string, number bigint, title string, body string, created_at string, url string, answered boolean"
ANSWERS = "id string, question_id string, author string, is_maintainer boolean, author_association string, body string, url string"
EDGES = f"id string, type string, src string, dst string, evidence {EVIDENCE}, extractor string, confidence string"
SIMILARITY = "question_id string, section_id string, sim double"
PROPOSALS = "batch_id string, section_id string, pos int, type string, concept string, span string, confidence string"
BALLOTS = "finding_id string, reader string, verdict string, reason string, evidence string"
VERDICTS = "question_id string, path string, verdict string, reason string"
THREADS = "number bigint, title string, body string, body_text string, created_at string, url string, answered boolean, answer struct<body:string,body_text:string,url:string,created_at:string,upvotes:bigint,author:string,author_association:string,is_maintainer:boolean>"

#: Each edge type joins one ordered pair of node kinds.
ENDS = {"CONTAINS": ("doc", "sec"), "LINKS_TO": ("sec", "doc"), "ANSWERED_BY": ("q", "ans"), "DEFINES": ("sec", "concept"), "REQUIRES": ("sec", "concept"), "MENTIONS": ("sec", "concept"), "ASKS_ABOUT": ("q", "concept")}
TO_CONCEPT = ("DEFINES", "REQUIRES", "MENTIONS")


class Graph:
    """The tables of one evidence graph; every node and edge once."""

    def __init__(self, docs: DataFrame, sections: DataFrame, concepts: DataFrame, questions: DataFrame, answers: DataFrame, edges: DataFrame) -> None:
        self.docs, self.sections, self.concepts, self.questions, self.answers, self.edges = docs, sections, concepts, questions, answers, edges

    def written(self) -> Graph:
        """The same graph with its edges, each once, written by type: readers of one type scan that type only, and shuffle nothing to drop repeats."""
        return Graph(self.docs, self.sections, self.concepts, self.questions, self.answers, materialize(self.edges, "graph", "type").select(*self.edges.columns))

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Graph:
        """The graph of a folder of parquet tables, threads taken as the questions."""
        table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
        once = lambda n: table(n).dropDuplicates(["id"])
        threads = table("discussions").select("number", "title", "body", "created_at", "url", "answered").dropDuplicates(["number"])
        return cls(once("docs"), once("sections"), once("concepts"), threads.selectExpr("concat('q:', number) AS id", "*"), once("answers"), once("edges"))
