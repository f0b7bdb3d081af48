"""aula.plans"""
