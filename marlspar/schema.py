"""Explicit schemas of the sources, the master job table, users, resumes and recommendations."""

from __future__ import annotations

from pyspark.sql import types as T

S, A = T.StringType(), T.ArrayType(T.StringType())


def strings(*names: str, arrays: tuple[str, ...] = ()) -> T.StructType:
    """A schema of nullable strings; those in ``arrays`` are arrays of strings."""
    return T.StructType([T.StructField(n, A if n in arrays else S) for n in names])


#: The columns of each source as it is captured.
RAW = {
    "linkedin": strings("title", "company", "location", "link", "description"),
    "structured": strings(
        "Job Title", "Job Link", "Company Name", "Experience", "Salary", "Location", "Job Description", "Skills", "Job Type", arrays=("Skills",)
    ),
    "naukri": strings("Job Title", "Job Link", "Company Name", "Experience", "Salary", "Location", "Job Description", "Skills", arrays=("Skills",)),
    "instahyre": strings("job_title", "company_name", "job_link", "location", "experience", "job_description", "skills", arrays=("skills",)),
    "cuvette": strings("company_logo", "title", "location", "skills", "job_type", "salary", "experience", "apply_url", arrays=("skills",)),
    "cuvette_csv": strings("Company Name", "Job Title", "Location", "Skills", "Job Type", "Salary", "Experience", "Job Link"),
    "goldman": strings("job_title", "job_link", "location", "job_type", "responsibilities", "technical_skills"),
    "ather": strings("job_title", "location", "description", "description1", "description2"),
    "krutrim": strings("job_title", "job_link", "job_description", "experience", "skills", arrays=("skills",)),
    "moneyview": strings("job_title", "department", "location", "emp_type", "job_posted_on", "job_link", "experience_range", "job_description"),
}

YOE = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

#: The string columns of the master table, in order.
JOB_STRINGS = (
    "job_title", "job_link", "company_name", "experience", "salary", "location", "job_description",
    "years_of_experience", "skills", "job_type", "id", "text",
)

JOB = T.StructType(
    [T.StructField(n, S) for n in JOB_STRINGS]
    + [T.StructField("Posted_date", T.DateType()), T.StructField("Source", S), T.StructField("yoe", YOE), T.StructField("job_indx", T.LongType())]
)

RESUME = T.StructType(
    [
        T.StructField("area_of_expertise", A),
        T.StructField("Name", S),
        T.StructField("Phone_number", S),
        T.StructField("Skills", A),
        T.StructField(
            "professional_experience",
            T.ArrayType(strings("company", "position", "duration", "achievements", "technologies", arrays=("achievements", "technologies"))),
        ),
        T.StructField("Achievements", A),
        T.StructField("Education", T.ArrayType(strings("institution", "degree", "duration", "cgpa", "percentage"))),
        T.StructField("Years_of_experience", S),
    ]
)

USER = T.StructType(
    [
        T.StructField("chat_id", T.LongType()),
        T.StructField("full_name", S),
        T.StructField("years_of_experience", T.DoubleType()),
        T.StructField("email", S),
        T.StructField("phone_number", S),
        T.StructField("resume_json", RESUME),
    ]
)
